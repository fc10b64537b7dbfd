"""The numbered operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as hs

import corpus_pipeline
from twinframe.llm import decontamination, language, lm, mixing, pii, quality, simhash, substrings, tokens, urls
from twinframe.llm.common import components, flat, xxh64_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "sel", "mon") for b in ("na", "lo", "ter", "vi", "shu", "pra", "gen")]


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [make_text(rng, rng.choice([3, 40, 120, 400])) for _ in range(40)]
    texts = base + [base[5]] * 6 + [base[6] + " extra words here", base[7][:200] + base[8][50:260], None, "", " \n\t", "é" * 300, "x" * 5000, "one", "12 34 !!"]
    texts += [base[9].replace("bana", "zzzz", 1), make_text(rng, 4000), "Mail a.b@c.example.org or +1 (555) 555-1234, 4111 1111 1111 1111, 10.0.0.1"]
    return [(i, t, rng.choice(["xx", "yy", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated ids, repeated rows, columns named as the operators' results."""
    some = rows[:12] + [rows[3], rows[3], (None, rows[4][1], "xx", "s1", 1), (5, "another text of the same id", "yy", "s2", 1)]
    return spark.createDataFrame([(*r, "a", 1.0) for r in some], SCHEMA + ", lang_pred string, score double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@given(hs.binary(max_size=400), hs.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_xxh64(data, seed):
    buf = np.frombuffer(data, np.uint8)
    assert int(xxh64_spans(buf, np.array([0]), np.array([len(data)]), seed)[0]) == xxhash.xxh64_intdigest(data, seed)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == r for x, r in low.items())


def test_url_filter(spark):
    u = ["https://a.example.com/en/7x?q", "http://example.COM/en/8", "https://x.example.net/de/8#t", "http://b.net/de/9", "ftp://z.org/es/", "z.org/es/", None, "http://", "https://a.example.com", "http://net/de/", "http://example.com:80/en/7"]
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate([*u, u[0]])], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.rule_table(spark)).collect()}
    assert got[0] == got[len(u)] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow")
    assert got[4][2:] == ("org/es/", "block") and got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8] == ("a.example.com", "", None, "allow")
    assert got[9][2] == "net/de/" and got[10] == ("example.com:80", "/en/7", None, "allow")
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.filter_urls(pages, urls.rule_table(spark).limit(0)).where("verdict = 'allow'").count() == len(u) + 1


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    got = urls.filter_urls(spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(zip(hosts, paths, strict=True))], "page_id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"))
    for r in got.collect():
        fit = [(len(h + p), len(h), v == "block", h + p, v) for (h, p), v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fit)[3:] if fit else (None, "allow"))


def expected_tokens(rows):
    t, out, at = tokens.Encoder().tokenizer, [], 0
    for i, x, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens(docs, rows, odd, empty):
    assert [tuple(r) for r in tokens.token_output(docs).orderBy("doc_id").collect()] == expected_tokens(rows)
    assert sorted((tuple(r) for r in tokens.token_output(odd).collect()), key=str) == sorted(expected_tokens([tuple(r)[:5] for r in odd.collect()]), key=str)
    assert tokens.token_output(empty).count() == 0


@given(hs.lists(hs.text(alphabet=hs.one_of(hs.sampled_from("aB'ré1 .,!\n\x01\x1c<|>+̸́ ｡ßİ"), hs.characters(codec="utf-8")), max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_tokens_by_stretches_are_the_whole_texts_tokens(texts):
    import pyarrow as pa

    e = tokens.encoder(None)
    ids, at = e.block(*flat(pa.array([*texts, "it's<|endoftext|>x", "<|ENDOFTEXT|>", "d'L'RE 12a"], pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [x + [2] for x in e.whole([*texts, "it's<|endoftext|>x", "<|ENDOFTEXT|>", "d'L'RE 12a"])]


def test_token_starts_with_several_files_a_task(spark, docs, odd, rows):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert [tuple(r) for r in tokens.token_output(docs).orderBy("doc_id").collect()] == expected_tokens(rows)
        assert sorted((tuple(r) for r in tokens.token_output(odd).collect()), key=str) == sorted(expected_tokens([tuple(r)[:5] for r in odd.collect()]), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_words_of_the_table_before_are_taken_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens.Encoder, "KEEP", 30)
    rng, e = random.Random(6), tokens.Encoder()
    for _ in range(20):
        texts = [make_text(rng, 12) for _ in range(3)]
        ids, at = e.block(*flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x + [2] for x in e.whole(texts)]


def test_token_files_prune_by_id(spark, docs, tmp_path):
    tokens.write_tokens(docs, str(tmp_path / "t"))
    one = tokens.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 7")
    assert one.count() == 1 and "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_quality(docs, rows, odd, empty):
    for r in quality.ledger(docs).collect():
        t = rows[r.doc_id][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + o for i, x in enumerate(win) if win.count(x) > 1 for o in range(3)} if len(w) < 1000 else None
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert again is None or r.n_repeat_words == len(again)
    assert quality.ledger(odd).count() == 16 and quality.ledger(empty).count() == 0
    a = {(r.policy, r.rule): r for r in quality.ablations(quality.ledger(docs)).collect()}
    found = [r.failed for r in quality.ledger(docs).collect()]
    assert a["v2", "too_few_words"].n_only == sum(f & quality.mask("v2") == 1 for f in found) and a["v1", "many_symbols"].n_failed == sum(f & quality.mask("v1") != 0 for f in found)


def test_mixing(docs, odd, empty):
    levels = mixing.tree(docs.source, docs.lang)
    got = mixing.copies(docs, levels).collect()
    total = sum(r.n_tokens for r in got)
    assert len(got) == docs.count() and sum(r.n_tokens * r.copies for r in got) <= 0.5 * total + 1e-6
    leaf = {}
    for r in got:
        leaf.setdefault((r.domain, r.lang, r.source), []).append(r)
    assert sum(rs[0].budget for rs in leaf.values()) == pytest.approx(0.5 * total)
    for rs in leaf.values():
        n, b = sum(r.n_tokens for r in rs), rs[0].budget
        epochs = int(b // n) if n else 0
        left, take = b - epochs * n, {}
        for r in sorted(rs, key=lambda r: int(hashlib.md5(f"42:{epochs}:{r.doc_id}".encode()).hexdigest()[:15], 16)):
            left -= r.n_tokens
            take[r.doc_id] = epochs + (left >= 0 and b > epochs * n)
        assert take == {r.doc_id: r.copies for r in rs}
    mixed = mixing.mix(docs, levels, max_epochs=2)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(odd, mixing.tree(odd.source, odd.lang), max_epochs=1).columns == odd.columns
    assert mixing.copies(empty, mixing.tree(empty.source, empty.lang)).count() == 0


def test_shortage_stays_among_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "domain string, lang string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, ["domain", "lang"], 0.5, 1, {}).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): pytest.approx(492.5), ("b", "x"): pytest.approx(502.5)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_spans(t):
    def ok(k, x):
        d = re.sub(r"\D", "", x)
        return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if ok(k, m[0]))


@given(hs.text(alphabet="a1.@+- ()4%é\n0", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t) == naive_spans(t)


def test_personal_data(spark, docs, rows, odd, empty):
    for r in pii.personal_data(docs).collect():
        assert [(x.start, x.kind, x.end) for x in r.base] == naive_spans(rows[r.doc_id][1] or "")
    assert pii.personal_data(odd).count() == 16 and pii.personal_data(empty).count() == 0
    d = spark.createDataFrame([(i, f'words and token = "{hashlib.sha1(bytes([i])).hexdigest()}" go on') for i in range(20)] + [(50 + i, f"the number {10**15 + 7 * i} stands alone") for i in range(20)], "doc_id long, text string")
    spans = {r.doc_id: [x.kind for x in r.spans] for r in pii.personal_data(d).collect()}
    assert all(spans[i] == [4] for i in range(20)) and not any(k > 3 for i in range(20) for k in spans[50 + i])
    long = "a" * 200_000 + "9" * 200_000 + "@"
    assert pii.base_spans(long) == [] and len(pii.candidates(long, [])) <= 1


def planted_personal_data():
    """(text, kind and string of what is planted or None) rows: every kind in several surroundings, and what only looks like it."""
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban():
        rest = "37040044" + digits(10)
        return f"DE{98 - int(rest + '131400') % 97:02d}{rest}"

    def surname():
        return rng.choice(["Smith", "Miller", "Okafor", "García", "Müller", "Novak", "Rossi"])

    good = {
        "secret": (lambda: hashlib.sha1(digits(9).encode()).hexdigest(), ["token = \"{}\" ", "my api_key: {} ", "password={}\n", "bearer {} "]),
        "account": (lambda: rng.choice([iban(), f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{digits(4)}", f"C{digits(8)}"]), ["account: {} ", "my iban is {} ", "passport {} was lost ", "ssn: {}, "]),
        "contact": (lambda: rng.choice([f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", f"{rng.randint(200, 999)}.{rng.randint(200, 999)}.{digits(4)}", f"0171 {digits(3)} {digits(4)}"]), ["call me at {} ", "phone: {}, ", "tel {} ", "fax {}\n"]),
        "person": (lambda: f"{rng.choice(['Anna', 'John', 'Lena', 'Omar'])} {surname()}", ["dear Mr. {}, ", "signed: {}\n", "name: {} ", "from Dr {} "]),
        "address": (lambda: rng.choice([f"{rng.randint(1, 999)} {surname()} Street", f"{surname()}straße {rng.randint(1, 99)}", f"{rng.randint(1, 99)} rue de {surname()}"]), ["he lives at {}, ", "address: {}\n", "office near {}, "]),
    }
    bad = [lambda: f"commit {hashlib.sha1(digits(9).encode()).hexdigest()} builds ", lambda: f"isbn {rng.randint(100, 999)}-{digits(10)} ", lambda: f"version {digits(2)}.{digits(2)} of {rng.randint(1, 28)}.12.2023 ", lambda: f"total {digits(12)} items ", lambda: "some-very-long-hyphenated-compound-word2 here "]
    out = []
    for k in range(600):
        pad = lambda: make_text(rng, rng.randint(2, 12)).replace(",\n", " ") + " "
        if k % 3:
            kind = rng.choice(sorted(good))
            make, frames = good[kind]
            own = make()
            out.append((pad() + rng.choice(frames).format(own) + pad(), (kind, own)))
        else:
            out.append((pad() + rng.choice(bad)() + pad(), None))
    return out


def test_added_spans_find_what_is_planted(spark):
    planted = planted_personal_data()
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")).collect()}
    hit, all_ = {}, {}
    for i, (text, own) in enumerate(planted):
        if own:
            all_[own[0]] = all_.get(own[0], 0) + 1
            at = text.index(own[1])
            hit[own[0]] = hit.get(own[0], 0) + any(s.start <= at and s.end >= at + len(own[1]) for s in found[i])
    clean = [i for i, (_, own) in enumerate(planted) if not own]
    assert all(hit[k] >= 0.9 * all_[k] for k in all_), (hit, all_)
    assert sum(not found[i] for i in clean) >= 0.9 * len(clean)


def test_reliabilities_against_rows_one_by_one():
    """Expectation-maximisation from counts equals the same on rows, with probabilities multiplied out."""
    rng = np.random.RandomState(3)
    rows_ = [(4 + int(k), tuple(int(x) for x in v)) for k, v in zip(rng.randint(0, 2, 80), rng.randint(-1, 2, (80, 3)), strict=True)]
    distinct = sorted(set(rows_))
    n = np.array([rows_.count(x) for x in distinct], float)
    truth, table = pii.reliabilities(np.array([k for k, _ in distinct]), np.array([v for _, v in distinct]), n, rounds=5)
    p = {x: 1 / (1 + np.exp(-sum(x[1]))) for x in distinct}
    prior, last = {0: {-1: 0.4, 0: 0.4, 1: 0.2}, 1: {-1: 0.2, 0: 0.4, 1: 0.4}}, {}
    for _ in range(5):
        new = {}
        for kind in (4, 5):
            own = [x for x in rows_ if x[0] == kind]
            share = {t: (sum(p[x] if t else 1 - p[x] for x in own) + 4) / (len(own) + 8) for t in (0, 1)}
            rel = {(j, t, v): (sum((p[x] if t else 1 - p[x]) for x in own if x[1][j] == v) + 4 * prior[t][v]) / (sum(p[x] if t else 1 - p[x] for x in own) + 4) for j in range(3) for t in (0, 1) for v in (-1, 0, 1)}
            for x in set(own):
                both = [share[t] * np.prod([rel[j, t, x[1][j]] for j in range(3)]) for t in (0, 1)]
                new[x] = both[1] / sum(both)
            last[kind] = rel
        p = new
    assert all(table[kind, j, t, v + 1] == pytest.approx(r) for kind, rel in last.items() for (j, t, v), r in rel.items())
    assert [p[x] for x in distinct] == pytest.approx(truth.tolist())


def test_many_spans_in_one_text_take_linear_time():
    import time

    x = "Call +1 (555) 555-1234 a.b@c.example.org token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and 1234567890123; "
    start = time.time()
    text = x * 10_000  # 1 MB
    base = pii.base_spans(text)
    more = pii.candidates(text, base)
    assert len(base) == 20_000 and len(more) >= 20_000 and time.time() - start < 20
    assert all(a[2] <= b[0] for a, b in zip(more[:-1], more[1:], strict=True))


def test_lm_gradient_and_normalisation():
    side = 16
    net = lm.Network(side, lm.Network(side).flat.astype(float)).start_from(np.arange(side * side + 1))
    rng = np.random.RandomState(0)
    context, target = rng.randint(0, side * side + 2, (40, 4)), rng.randint(0, side * side + 1, 40)
    grad = np.zeros_like(net.flat)
    net.forward(context, target, grad)
    for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-6), 15):
        old, losses = net.flat[i], []
        for step in (1e-5, -1e-5):
            net.flat[i] = old + step
            losses.append(-net.forward(context, target).mean())
        net.flat[i] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[i], abs=1e-6)
    assert sum(np.exp(net.forward(context[:1], np.array([t]))[0]) for t in range(side * side + 1)) == pytest.approx(1)


def lm_tokens(t):
    return re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def naive_scores(pairs, side, words, flat_net, spell):
    """Each text's score, token by token, with the softmax written out and the counts of all texts."""
    from collections import Counter

    v = {k: x.astype(float) for k, x in lm.Network(side, flat_net).views.items()}
    index = {int(h): i for i, h in enumerate(words)}
    rare, outside = side * side, side * side + 1
    spelled = spell.reshape(257, 257)
    texts = [(i, lm_tokens(t)) for i, t in pairs]
    ids = lambda w: [index.get(xxhash.xxh64_intdigest(x.encode(), 42), rare) for x in w]
    triples = Counter((w[k - 1], x, w[k + 1] if k + 1 < len(w) else None) for _, w in texts for k, x in enumerate(w) if k and ids([w[k - 1]])[0] == rare)
    contexts = Counter()
    for (left, _, right), n in triples.items():
        contexts[left, right] += n
    out = []
    for i, w in texts:
        at, plain, total = [outside, outside, *ids(w), outside, outside], 0.0, 0.0
        for k, x in enumerate(w):
            h = np.tanh(sum(v["embed"][s][at[k + 2 + d]] for s, d in enumerate((-2, -1, 1, 2))) + v["bias"])
            own = at[k + 2]
            z = v["classes"] @ h + v["class_bias"]
            c = int(own**0.5)
            log = z[c] - np.log(np.exp(z).sum())
            if own != rare:
                z = v["words"][c * c : (c + 1) ** 2] @ h + v["word_bias"][c * c : (c + 1) ** 2]
                log += z[own - c * c] - np.log(np.exp(z).sum())
            if own == rare:
                b = [256, *x.encode(), 256]
                log += sum(spelled[p, q] for p, q in zip(b[:-1], b[1:], strict=True))
            plain += log
            if k and at[k + 1] == rare:
                right = w[k + 1] if k + 1 < len(w) else None
                n, m = triples[w[k - 1], x, right] - 1, contexts[w[k - 1], right] - 1
                log = np.log((n + lm.PRIOR * np.exp(log)) / (m + lm.PRIOR))
            total += log
        out.append((i, len(w), plain, total))
    return out


def test_lm(spark, docs, rows, odd, empty, monkeypatch):
    monkeypatch.setattr(lm, "MIN_WORDS", 25)  # so that most tokens are none of the outputs
    monkeypatch.setattr(lm, "GROWTH", 0.1)
    model = lm.fit(docs)
    side, words, flat_net, spell = model
    assert side == 5 and len(words) == 25
    got = {r.doc_id: r for r in lm.score(docs, *model).collect()}
    for i, n, log, counted in naive_scores([r[:2] for r in rows], *model):
        assert got[i].n_tokens == n and got[i].log_prob == pytest.approx(log, rel=1e-4, abs=1e-3) and got[i].counted_log_prob == pytest.approx(counted, rel=1e-4, abs=1e-3)
        assert got[i].mean_log_prob == (pytest.approx(log / n, rel=1e-4, abs=1e-3) if n else None)
        assert got[i].mean_counted_log_prob == (pytest.approx(counted / n, rel=1e-4, abs=1e-3) if n else None)
    assert np.allclose(np.exp(spell.reshape(257, 257)).sum(axis=1), 1)
    many = {r.doc_id: r.counted_log_prob for r in lm.score(docs, *model, bucket_bytes=500).collect()}
    assert all(many[i] == pytest.approx(r.counted_log_prob, rel=1e-6, abs=1e-6) for i, r in got.items())
    counts = lm.vocabulary(docs)[2]
    fresh = {r.doc_id: r for r in lm.score(docs, side, words, lm.Network(side).start_from(counts).flat, spell).collect()}
    assert sum(r.log_prob for r in got.values()) > sum(r.log_prob for r in fresh.values())
    # rows that agree in all are scored alike, and so are those of null ids
    odd_rows = [tuple(r)[:2] for r in odd.collect()]
    want = naive_scores(odd_rows, *model)
    scored = [(r.doc_id, r.n_tokens, r.log_prob, r.counted_log_prob) for r in lm.score(odd, *model).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert [r[:2] for r in sorted(scored, key=key)] == [r[:2] for r in sorted(want, key=key)]
    for k in (2, 3):
        assert [r[k] for r in sorted(scored, key=key)] == pytest.approx([r[k] for r in sorted(want, key=key)], rel=1e-4, abs=1e-3)
    assert lm.score(empty, *lm.fit(empty)).count() == 0


def test_lm_does_not_depend_on_the_number_of_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    one = {r.doc_id: (r.log_prob, r.counted_log_prob) for r in lm.score(docs.coalesce(1), *lm.fit(docs.coalesce(1))).collect()}
    many = {r.doc_id: (r.log_prob, r.counted_log_prob) for r in lm.score(docs.repartition(16), *lm.fit(docs.repartition(16))).collect()}
    assert all(many[i] == pytest.approx(x, rel=1e-5, abs=1e-5) for i, x in one.items())


def test_lm_tells_repeats_apart(spark):
    rng = random.Random(12)
    lexicon = [make_text(rng, 1).strip(".,\n") + make_text(rng, 1).strip(".,\n") + str(k) for k in range(3000)]
    texts = [" ".join(rng.choice(lexicon if rng.random() < 0.5 else WORDS) for _ in range(120)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    got = {r.doc_id: r.mean_counted_log_prob for r in lm.score(docs, *lm.fit(docs)).collect()}
    assert min(got[i] for i in [*range(20), *range(200, 220)]) > max(got[i] for i in range(20, 200))


def tiles_of_pairs(doc: np.ndarray, item: np.ndarray, pairs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The shipped tiling from all seed pairs (document position, item position) instead of each match's first."""
    diagonal = pairs[:, 0] - pairs[:, 1]
    order = np.lexsort((pairs[:, 0], diagonal))
    pairs, diagonal = pairs[order], diagonal[order]
    new = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(pairs[:, 0]) != 1)) + 1
    return decontamination.greedy(doc, item, [(int(b - a) + size - 1, int(pairs[a, 1]), int(pairs[a, 0])) for a, b in zip([0, *new], [*new, len(pairs)], strict=True)], size)


def naive_substrings(pairs):
    seen, out = set(), []
    for _, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "wide"), [(substrings.HOT, substrings.WIDE), (2, substrings.WIDE), (substrings.HOT, 1)])
def test_substrings(docs, rows, hot, wide):
    want = naive_substrings([(r[0], r[1]) for r in rows])
    if wide == 1:
        told = substrings.wide_anchors(docs.selectExpr("doc_id AS id", "text"), wide, 1)
        assert 0 < len(told) == len(set(told.tolist()))
    got = [tuple(r)[1:] for r in substrings.dedup_substrings(docs, hot=hot, wide=wide, sample=1).orderBy("doc_id").collect()]
    assert got == want and sum(w[1] for w in want) > 5000


def test_substrings_of_odd_rows(odd, empty):
    got = substrings.dedup_substrings(odd).collect()
    assert len(got) == 16 and sum(r.n_removed for r in got if r.doc_id == 3) == 0 and next(r for r in got if r.doc_id is None).n_removed > 0
    assert substrings.dedup_substrings(empty).count() == 0


def naive_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hs_ = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs_) > len(hs_))


def naive_components(fps):
    low = list(range(len(fps)))
    for _ in fps:
        new = [min(low[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == low:
            return low
        low = new
    return low


def test_simhash(docs, rows, odd, empty):
    got = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    fps = [naive_fingerprint(r[1]) for r in rows]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps] and [r.component_id for r in got] == naive_components(fps)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})
    ids = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert ids.count(3) == 1 and None in ids
    assert simhash.near_duplicates(empty).count() == 0


def naive_copies(texts):
    """For each text the least index of its component, by the exact Jaccard index of five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b)] for a in sets]
    low = list(range(len(texts)))
    while (new := [min(low[j] for j in js) for js in near]) != low:
        low = new
    return low


def test_near_copies_by_jaccard(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):  # a text, copies with some words changed, and copies of those
        w = make_text(rng, 200).split()
        texts.append(" ".join(w))
        for n in (1, 2, 4, 6, 9, 15):
            x = list(w)
            for i in rng.sample(range(200), n):
                x[i] = f"new{rng.random()}"
            texts.append(" ".join(x))
    low = naive_copies(texts)
    fps = [naive_fingerprint(t) for t in texts]
    assert len(set(low)) < len(set(naive_components(fps)))  # two bits don't see them all
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(low)


@pytest.mark.parametrize(("keys", "size"), [(5, 2 << 20), (256, 3000), (256, 2 << 20)])
def test_alike_but_no_copies(spark, monkeypatch, keys, size):
    """A large group of short texts that are alike, most of them below the similarity, in tiles of any size."""
    monkeypatch.setattr(simhash, "TILE_KEYS", keys)
    monkeypatch.setattr(simhash, "TILE_BYTES", size)
    rng = random.Random(10)
    base, texts = make_text(rng, 60).split(), []
    for i in range(90):
        x = list(base) if i % 3 else texts[rng.randrange(len(texts))].split() if texts else list(base)
        for at in rng.sample(range(60), rng.choice([1, 1, 2])):
            x[at] = f"new{rng.random()}"
        texts.append(" ".join(x))
    low = naive_copies(texts)
    assert 10 < len(set(low)) < 80
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(low)


def test_tile_links():
    sets = [set(range(20)), set(range(1, 21)), set(range(10, 30)), set(range(40, 60)), set(range(20))]
    items = [np.array(sorted(x), np.uint64).tobytes() for x in sets]
    rows = pa.table({"root": [1, 2, 3, 4, 5], "part": [0, 0, 0, 0, 0], "lo": [0] * 5, "hi": [0] * 5, "items": items})
    assert simhash.tile_links(rows) == [(1, 2), (1, 5)]
    apart = rows.set_column(1, "part", pa.array([0, 0, 1, 1, 1])).set_column(3, "hi", pa.array([1] * 5))
    assert simhash.tile_links(apart) == [(1, 5), (2, 5)]
    empty = rows.set_column(4, "items", pa.array([b""] * 5))
    assert simhash.tile_links(empty) == [(1, 2), (1, 3), (1, 4), (1, 5)]


def test_keep_one_counts_rows_not_ids(spark):
    rng = random.Random(9)
    a, b, c = (make_text(rng, 60) for _ in range(3))
    texts = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, a), (5, c), (4, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in texts], SCHEMA).repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (4, c), (None, c)], key=str)


@pytest.mark.parametrize("shard_max", [1024, 3])
def test_links_by_trees_and_by_neighbours(spark, shard_max):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for _ in range(8):
            x = f
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), shard_max)).collect()}
    groups = {}
    for f, low in zip(fps, naive_components(fps), strict=True):
        groups.setdefault(low, set()).add(roots.get(signed[f], signed[f]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_decontamination(spark, docs, rows, odd, empty):
    rng = random.Random(9)
    a, b = make_text(rng, 40).split(), make_text(rng, 30).split()
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, None), (4, "zy zz"), (5, " ".join(a))], "item_id long, text string")
    texts = {0: " ".join(["q w e", *a[20:], "mid", *a[:20], "end"]).upper(), 1: " ".join(a[:20]), 2: "x zy zz y", 3: " ".join(w + "!" for w in b), 4: None, 5: "", 6: "zy and zz"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(d, items).collect()}
    assert set(got) == {(0, 1), (0, 5), (2, 4), (3, 2)} and got[0, 1].coverage == 1.0 and got[0, 1].n_tiles >= 2
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, items, max_seeds=10).collect()} == set(got)
    assert sorted(r.doc_id for r in decontamination.keep_clean(d, items).collect()) == [1, 4, 5, 6]
    assert decontamination.keep_clean(odd, items).columns == odd.columns and decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(d, items.limit(0)).count() == 0


def naive_leaks(docs, items, coverage):
    """Every document against every item, from all pairs of equal seeds."""
    out = []
    for r, x in enumerate(docs):
        for k, y in enumerate(items):
            h, g = (decontamination.tokens(*flat(__import__("pyarrow").array([t])))[0] for t in (x, y))
            size = min(5, len(g))
            pairs = np.array([(i, j) for i in range(len(h) - size + 1) for j in range(len(g) - size + 1) if (h[i : i + size] == g[j : j + size]).all()])
            if size and len(pairs):
                tiles = tiles_of_pairs(h, g, pairs, size)
                covered = sum(t[0] for t in tiles)
                if covered >= coverage * len(g):
                    out.append((r, k, covered, len(tiles), tiles[0][0]))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(31)
    passage = lambda n, letters="abc": " ".join(rng.choice(letters) for _ in range(n))
    items = [passage(rng.randint(1, 25)) for _ in range(12)] + [passage(30, WORDS) for _ in range(6)]
    docs = [passage(rng.randint(0, 80)) for _ in range(30)] + ["", "a " * 300, "a b " * 100]
    for x in items[12:]:
        w = x.split()
        docs += [passage(40, WORDS) + " " + x + " " + passage(40, WORDS), " ".join([*w[18:], "between", *w[:18]]), " ".join(w[:20])]
    got = decontamination.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = naive_leaks(docs, items, decontamination.COVERAGE)
    assert sorted((r.doc_id, r.item_id, r.covered_tokens, r.n_tiles, r.longest_tile) for r in got.collect()) == want and len(want) > 30


def test_one_repeated_token_takes_linear_time():
    import pyarrow as pa

    index = decontamination.Index([(1, "the " * 300), (2, "the cat " * 100)])
    found = index.scan(*flat(pa.array(["the " * 200_000, "cat the " * 1000])), 0.8)
    assert [(r, k, n, tiles) for r, k, _, n, tiles, _ in found] == [(0, 0, 300, 1), (1, 1, 200, 1)]


def test_pairs_are_made_in_parts_of_rows(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    shared = make_text(rng, 12)
    items = [(i, f"{shared} {make_text(rng, 10)}") for i in range(20)]
    index = decontamination.Index(items)
    buf, offsets = flat(pa.array([f"{shared} {i} {items[i % 20][1]}" if i % 3 else shared for i in range(30)]))
    whole = index.scan(buf, offsets, 0.8)
    monkeypatch.setattr(decontamination, "MAX_PAIRS", 7)
    assert index.scan(buf, offsets, 0.8) == whole and len(whole) >= 20


def test_tiles_are_greedy_and_disjoint():
    rng = np.random.RandomState(4)
    for _ in range(50):
        doc, item = rng.randint(0, 3, 60).astype(np.uint64), rng.randint(0, 3, 25).astype(np.uint64)
        pairs = np.array([(i, j) for i in range(56) for j in range(21) if (doc[i : i + 5] == item[j : j + 5]).all()])
        if not len(pairs):
            continue
        in_doc, in_item, want = set(), set(), []
        while True:  # longest unmarked match, then the smallest places
            best = None
            for j in range(25):
                for i in range(60):
                    n = 0
                    while i + n < 60 and j + n < 25 and doc[i + n] == item[j + n] and i + n not in in_doc and j + n not in in_item:
                        n += 1
                    if n >= 5 and (best is None or n > best[0]):
                        best = (n, j, i)
            if best is None:
                break
            want.append(best)
            in_doc |= set(range(best[2], best[2] + best[0]))
            in_item |= set(range(best[1], best[1] + best[0]))
        assert tiles_of_pairs(doc, item, pairs, 5) == want


def test_language(spark, odd, empty):
    rng = random.Random(7)
    lexicon = {"aa": ["le", "que", "tion", "pour", "des", "eau"], "bb": ["the", "ing", "and", "of", "was", "with"], "cc": ["und", "der", "schu", "keit", "ich", "auf"]}
    rows = [(i, " ".join(rng.choice(lexicon[k]) + rng.choice(lexicon[k]) for _ in range(12)), k) for i in range(300) for k in [rng.choice(sorted(lexicon))]]
    rows += [(400, None, "aa"), (401, "123 ... !", "aa"), (402, "é" * 3000, None), (403, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d.where(~language.held_out(d.doc_id)))
    got = {r.doc_id: r for r in language.predict(d, model).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    assert got[400].lang_pred == got[401].lang_pred == got[403].lang_pred == "und" and got[402].lang_pred in lexicon
    none = language.predict(d, language.fit(d.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.keep_known(odd).columns == odd.columns and language.keep_known(empty).count() == 0


def test_language_stage_rejects_what_no_learned_language_explains(spark):
    rng = random.Random(17)
    lexicon = {"aa": ["le", "que", "tion", "pour", "des", "eau"], "bb": ["the", "ing", "and", "of", "was", "with"]}
    word = lambda k: rng.choice(lexicon[k]) + rng.choice(lexicon[k])
    clean = [(i, " ".join(word(k) for _ in range(rng.choice([3, 12, 60]))), k) for i in range(300) for k in [rng.choice(sorted(lexicon))]]
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24))
    clean += [(1000 + i, f"{key()} {word('bb')} {word('bb')} {word('bb')}", "bb") for i in range(20)]  # a name: one word decides nothing
    clean += [(1100 + i, f"{word('aa')} 0cf6a1f{i}ed6e2f11c6ae2d0e28ac6x2cf81b {word('aa')} {word('aa')}", "aa") for i in range(20)]  # a key
    foreign = ["tämä on suomenkielinen teksti jossa puhutaan säästä ja järvistä sekä metsistä joita maassa on paljon", "это русский текст о погоде озерах и лесах"]
    foreign += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(30)) for _ in range(20)]
    bad = [(2000 + i, t, None) for i, t in enumerate([*foreign, None, "", "12 !"])]
    d = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string").repartition(3)
    assert sorted(r.doc_id for r in language.keep_known(d).collect()) == [r[0] for r in clean]
    assert language.keep_known(d.drop("lang").selectExpr("*", "cast(null as string) AS lang")).count() == 0  # nothing labelled


def test_forward_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ", b"ba", b"bab"]
    p = np.random.RandomState(1).dirichlet(np.ones(len(pieces)), 2).T

    def total(w, k):
        return 1.0 if not w else sum(p[i, k] * total(w[len(x) :], k) for i, x in enumerate(pieces) if w.startswith(x))

    words = [b" abab", b" bab", b"ab", b"b"]
    m, lengths, order = language._matrix(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, 5, 4, 2]), np.cumsum([5, 4, 2, 1]), np.zeros(4, bool))
    lattice = language.Lattice(pieces)
    got = np.exp(lattice.log_prob(m, lengths, p))
    assert np.allclose(got, [[total(words[i], k) for k in range(2)] for i in order])
    n = np.array([[2.0, 1.0]] * 4)
    used = lattice.expected(m, lengths, p, n)
    assert np.isclose((used * np.array([[len(x)] for x in pieces])).sum(), sum(map(len, words)) * 3)


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, last = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, sf)
        last.write.parquet(str(tmp_path / name))
        last = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or last.columns == cols
        kept[name] = {r.doc_id for r in last.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept["language"] == set(texts)
    assert kept["near_duplicates"] == {sorted(texts)[x] for x in naive_copies([texts[i] for i in sorted(texts)])}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {i for i in kept["near_duplicates"] if any(b in texts[i] for b in bench)}
    assert gone <= kept["near_duplicates"] - kept["decontamination"] and len(kept["near_duplicates"] - kept["decontamination"]) <= len(gone) + 2
    rows = sorted((i, texts[i]) for i in kept["mixing"])
    assert [tuple(r) for r in last.orderBy("doc_id").collect()] == expected_tokens(rows) and 0 < len(rows) < len(kept["decontamination"])


def test_mix_keeps_columns_of_any_name(spark, docs):
    clash = docs.selectExpr("*", "1 AS copies_", "2 AS copy_", "3 AS epochs_", "4 AS last_", "5 AS level_0_", "6 AS cut_level_0_", "7 AS budget")
    for epochs in (1, 2):
        mixed = mixing.mix(clash, mixing.tree(clash.source, clash.lang), max_epochs=epochs)
        plain = mixing.mix(docs, mixing.tree(docs.source, docs.lang), max_epochs=epochs)
        assert mixed.columns == clash.columns
        assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in plain.collect())
        assert mixed.where("copies_ = 1 AND copy_ = 2 AND epochs_ = 3 AND last_ = 4 AND level_0_ = 5").count() == plain.count()


def test_url_rules_with_many_path_lengths(spark):
    long = "/" + "x" * 3000
    rules = spark.createDataFrame([("a.org", long[:n], "block" if n % 2 else "allow") for n in range(1, 300)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(0, "http://a.org" + long), (1, "http://b.a.org/x"), (2, "http://org/"), (3, "")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {0: ("a.org" + long[:299], "block"), 1: ("a.org/x", "allow"), 2: (None, "allow"), 3: (None, "allow")}


def test_near_copies_go_through_the_trees(spark):
    """The stage's fingerprints are those of the sets, and a tree's links are pairs within the radius, enough to join all of them."""
    fps = [0, 1, 3, 7 << 40, 7 << 40 | 1, (1 << 64) - 1, (1 << 64) - 1]
    keyed = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "key long, fp long")
    pairs = [(r.a, r.b) for r in simhash.tree_pairs(keyed).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS for a, b in pairs)
    assert sorted(map(sorted, simhash.forest(*map(list, zip(*pairs, strict=True))))) == sorted(map(sorted, pairs)) and len({min(a, b) for a, b in pairs} | {max(a, b) for a, b in pairs}) == 7 and len(pairs) == 4
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), "", "one"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    h, first, _ = simhash.shingle_sets(buf, offsets)
    got = simhash.simhashes(h, first)
    assert got[2] == 0 and int(got[0] ^ got[1]).bit_count() <= 4 and (got[[0, 3]] == simhash.fingerprint_block(buf, offsets, simhash.COPY_SHINGLE)[[0, 3]]).all()
