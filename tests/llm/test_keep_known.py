"""The pipeline's language stage on real sentences, with the model of the driver's invented texts."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinframe.llm import language

TABLE = "/root/testdata/sf0.01/documents.parquet"
REAL = {
    "en": ["The weather is nice today.", "Please send me the report by Friday.", "Our company was founded in the last century by two brothers.", "Where is the nearest train station?"],
    "fr": ["Il fait beau aujourd'hui.", "Veuillez m'envoyer le rapport avant vendredi.", "Notre entreprise a été fondée par deux frères au siècle dernier.", "Où est la gare la plus proche?"],
    "es": ["Hace buen tiempo hoy.", "Por favor, envíeme el informe antes del viernes.", "Nunca he visto un jardín tan hermoso.", "¿Dónde está la estación de tren más cercana?"],
    "de": ["Das Wetter ist heute schön.", "Ich habe noch nie einen so schönen Garten gesehen.", "Unsere Firma wurde im letzten Jahrhundert von zwei Brüdern gegründet.", "Wo ist der nächste Bahnhof?"],
}
#: languages that no row is labelled with
OTHER = [
    "Pieni poika käveli hitaasti metsän läpi, kun hän yhtäkkiä kuuli oudon äänen puiden takaa eilen illalla.",
    "Küçük çocuk ormanda yavaşça yürürken aniden ağaçların arkasından garip bir ses duydu ve çok korktu.",
    "A kisfiú lassan sétált az erdőben, amikor hirtelen furcsa hangot hallott a fák mögül tegnap este.",
    "Mały chłopiec szedł powoli przez las, kiedy nagle usłyszał dziwny dźwięk zza drzew wczoraj wieczorem.",
    "Маленький мальчик медленно шел по лесу, когда вдруг услышал странный звук за деревьями.",
    "小男孩在森林里慢慢地走着，突然听到树后面传来奇怪的声音。",
]


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the driver's tables")
def test_real_sentences_stay_and_others_go(spark):
    docs = spark.read.parquet(TABLE)
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(25)) for _ in range(8)]
    texts = [(True, " ".join([t] * r)) for own in REAL.values() for t in own for r in (1, 4, 20)]
    texts += [(False, " ".join([t] * r)) for t in OTHER for r in (1, 4, 20)] + [(False, t) for t in noise]
    extra = spark.createDataFrame([(10**8 + i, t, None, "s", len(t)) for i, (_, t) in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in language.keep_known(docs.unionByName(extra)).select("doc_id").collect()}
    assert [t for i, (stays, t) in enumerate(texts) if (10**8 + i in kept) != stays] == []
    assert sum(k < 10**8 for k in kept) == docs.count()


def test_every_labelled_document_counts(spark):
    """A language whose labelled rows come after 8,000 others is learned and stays; the typical gain is that of all held-out rows."""
    ids = spark.range(11_500).select(F.col("id").alias("doc_id"))
    last = F.row_number().over(Window.orderBy(language.held_out(F.col("doc_id")), F.xxhash64("doc_id"), "doc_id")).between(8_001, 8_500)
    lang = F.when(last, "fi").otherwise("en")
    docs = ids.withColumn("lang", lang).withColumn("text", F.when(F.col("lang") == "fi", OTHER[0]).otherwise("The weather is nice today, please send me the report."))
    assert docs.where("lang = 'fi'").where(~language.held_out(F.col("doc_id"))).count() == 500
    kept = language.keep_known(docs)
    assert {(r.lang, r["count"]) for r in kept.groupBy("lang").count().collect()} == {("en", 11_000), ("fi", 500)}
    held = ids.where(language.held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    scored = held.select("doc_id", F.lit("t").alias("text"), F.lit("en").alias("lang"), rank.cast("double").alias("gain_"), F.lit(1).alias("bytes_"))
    assert language.typical(scored) == (held.count() + 1) / 2
