"""Operator 5, personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Wide patterns propose further candidates: keys
(secret), telephone numbers without a country code (contact), account, identity and other long numbers (account), names
after a title or a label (person), streets with a house number (address). Labelers vote on each: a format check, a gazetteer
of words that speak for or against the kind nearby, the characters around it, its shape, and check digits.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind, and so how
likely each pattern is true; a logistic span classifier is then trained on these soft labels. It doesn't see the votes but
features of the span and its surroundings, and decides which candidates become spans.
Votes and counts come from all documents; votes and features have few distinct combinations, so training takes a small table.

Defined results: null counts as empty; base spans of different kinds may overlap and all stay, but a candidate never
overlaps a base span or another candidate (the leftmost stays, then the kind listed first); without candidates nothing is
added; repeated rows are judged alike. Time is linear in a text's length and its number of spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import blocks, cut, documents

KINDS = ("email", "ip", "card", "phone", "secret", "contact", "account", "person", "address")
BASE = 4
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: a match can only begin at a run's first digit, so possessive runs find the same spans in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]{1,20}+"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme)"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square)"
#: wide patterns by kind; each proposes more than is true
PROPOSALS: dict[str, tuple[re.Pattern, ...]] = {
    "secret": (re.compile(r"(?<![A-Za-z0-9_-])(?![A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_-]))(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}+"),),
    "contact": (
        re.compile(r"(?<![0-9+.])\([0-9]{2,5}\)[\x20-]?[0-9]{2,4}[\x20.-]?[0-9]{3,5}(?![0-9])"),
        re.compile(r"(?<![0-9+.-])[0-9]{3}[.\x20-][0-9]{3}[.\x20-][0-9]{4}(?![.\x20-]?[0-9])"),
        re.compile(r"(?<![0-9+.,-])0[1-9][0-9]{1,3}[\x20/-][0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,2}(?![0-9])"),
    ),
    "account": (
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        re.compile(r"(?<![0-9.,-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        re.compile(r"(?<![0-9.,+-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![\x20-]?[0-9])"),
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])"),
    ),
    "person": (re.compile(rf"(?<![A-Za-z]){_TITLE}\.?\x20(?P<span>{_NAME}(?:\x20{_NAME}){{0,2}})"), re.compile(rf"(?<![A-Za-z])(?:[Nn]ame|[Nn]ombre|[Nn]om|signed)(?::\x20?|\x20is\x20)(?P<span>{_NAME}(?:\x20{_NAME}){{1,2}})")),
    "address": (
        re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,5}}[A-Za-z]?\x20(?:{_NAME}\x20){{1,3}}{_STREET}(?![a-z])"),
        re.compile(r"(?<![A-Za-z])[A-ZÄÖÜ][a-zäöüß]{1,20}(?:straße|strasse|weg|platz|allee)\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])"),
        re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place)\x20(?:de\x20(?:la\x20)?|du\x20|des\x20)?{_NAME}"),
        re.compile(rf"(?<![A-Za-z])(?:[Cc]alle|[Aa]venida|[Pp]laza)\x20(?:de\x20(?:la\x20)?|del\x20)?{_NAME},?\x20[0-9]{{1,4}}(?![0-9])"),
    ),
}
#: texts that could hold a person's name, for the search engine of Arrow
_PEOPLE = rf"(^|[^A-Za-z])({_TITLE[3:-1]})\.? \S|([Nn]ame|[Nn]ombre|[Nn]om|signed)(:| is )"
#: gazetteers: words that speak for a kind, and such that speak against it
CUES: dict[str, frozenset[str]] = {
    "secret": frozenset("token secret password passwd apikey api_key access_key key bearer credential credentials auth authorization signature private".split()),
    "account": frozenset("account acct iban bank card visa mastercard ssn social security passport licence license id identity tax nif dni steuer konto kontonummer compte cuenta".split()),
    "contact": frozenset("phone tel telephone fax mobile cell call contact telefon handy rufnummer téléphone teléfono móvil whatsapp reach".split()),
    "person": frozenset("name contact patient customer client dear from signed attention attn sincerely author by with".split()),
    "address": frozenset("address at lives live residence located adresse anschrift wohnt dirección domicilio habite office near".split()),
}
AGAINST: dict[str, frozenset[str]] = {
    "secret": frozenset("commit sha sha1 sha256 md5 checksum revision hash digest build".split()),
    "account": frozenset("isbn issn page pages version year population total order item items price ticket sum part model views timestamp".split()),
    "contact": frozenset("isbn page version score ratio total order item price version build part".split()),
    "person": frozenset("river lake mount street saint film song book chapter".split()),
    "address": frozenset("about over nearly chapter page population score version".split()),
}
LABELERS = ("format", "gazetteer", "context", "shape", "check")
_WINDOW = 32
_WORD = re.compile(r"[^\W\d]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Check digits of an international account number."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and without overlap for each kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of proposals that touch no base span and no proposal further left, and that no word right before
    names as something else (a commit, a total)."""
    starts, ends = [], []  # the base spans' union, as disjoint intervals
    for s, _, e in taken:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = sorted({(m.start("span") if "span" in m.re.groupindex else m.start(), BASE + k, m.end()) for k, patterns in enumerate(PROPOSALS.values()) for p in patterns for m in p.finditer(text)}, key=lambda x: (x[0], x[1], -x[2]))
    out, last = [], 0
    for s, kind, e in found:
        i = bisect_left(starts, e) - 1  # the last interval that begins before the end
        if s >= last and (i < 0 or ends[i] <= s) and not set(_WORD.findall(text[max(0, s - _WINDOW) : s].lower())[-1:]) & AGAINST[KINDS[kind]]:
            out.append((s, kind, e))
            last = e
    return out


#: number of values of each feature of the span classifier
FEATURES = {"length": 4, "digits": 4, "distinct": 3, "separators": 3, "upper": 2, "before": 4, "after": 3, "said": 3, "assigned": 2}


def judge(text: str, start: int, kind: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Each labeler's vote (1 for, -1 against, 0 none), and the features."""
    name = KINDS[kind]
    span, before, after = text[start:end], text[max(0, start - _WINDOW) : start].lower(), text[end : end + 2]
    digits = re.sub(r"\D", "", span)
    compact = re.sub(r"[\x20-]", "", span)
    near = set(_WORD.findall(before.replace("_", " "))) | set(before.split())
    said = 1 if near & CUES[name] else -1 if near & AGAINST[name] else 0
    assigned = bool(re.search(r"[=:][\s\"']*$", before)) or (before[-1:] in ("'", '"') and after[:1] == before[-1:])
    alone = not before or before[-1].isspace() or before[-1] in "([{<\"':=,;>#|"
    check = 0
    if name == "secret":
        form = 1 if (_HEX.fullmatch(span) and len(span) in (32, 40, 48, 64)) or (any(c.isupper() for c in span) and any(c.islower() for c in span)) else -1
        around = 1 if assigned else -1
        shape = 0 if len(set(span)) >= 8 and len(digits) >= 4 else -1  # the format says all that speaks for it
    elif name == "account":
        iban = span[:2].isalpha() and len(compact) >= 15
        form = 1 if iban or re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,9}", span) else -1 if len(digits) > 19 else 0
        around = 1 if assigned else 0 if said > 0 else -1
        shape = 1 if iban or " " in span or "-" in span else 0
        check = (1 if mod97(compact) else -1) if iban else (1 if luhn(digits) else -1) if len(digits) >= 12 else 0
    elif name == "contact":
        form = 1 if span[0] in "(0" or 10 <= len(digits) <= 11 else -1
        around = 1 if assigned or alone else -1
        shape = 1 if 9 <= len(digits) <= 12 else -1
    elif name == "person":
        form = 1 if 2 <= len(span.split()) <= 3 else 0
        around = 1 if assigned or before.rstrip()[-1:] == "." or before[-1:] == " " else -1
        shape = 1 if all(2 <= len(w) <= 15 for w in span.split()) else -1
    else:
        form = 1 if digits and len(span.split()) <= 5 else -1
        around = 1 if alone else -1
        shape = 1 if 1 <= len(digits) <= 5 else -1
    letter_before = 0 if not before else 1 if before[-1].isspace() else 2 if before[-1] in "\"'=:([{<" else 3
    letter_after = 0 if not after else 1 if after[0].isspace() or after[0] in ".,;:!?\"')]}>" else 2
    share = len(digits) / len(span)
    features = (
        min(3, len(span).bit_length() - 3 if len(span) >= 8 else 0), 0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.8 else 3, 0 if len(set(span)) < 5 else 1 if len(set(span)) < 10 else 2,
        min(2, sum(c in " -./()" for c in span)), int(any(c.isupper() for c in span)), letter_before, letter_after, said + 1, int(assigned))
    return (form, said, around, shape, check), features


def encode(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    out = kind - BASE
    for v in votes:
        out = out * 3 + v + 1
    for x, n in zip(features, FEATURES.values(), strict=True):
        out = out * n + x
    return out


def decode(code: int) -> tuple[int, list[int], list[int]]:
    features, votes = [], []
    for n in reversed(FEATURES.values()):
        features.append(code % n)
        code //= n
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code //= 3
    return code + BASE, votes[::-1], features[::-1]


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, base array of (start, kind, end), more array of (start, kind, end, code)) of each row."""
    interesting = np.zeros(256, np.int64)
    interesting[48:58] = interesting[64] = 1
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    more_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text"):
            base: list[list] = [[] for _ in range(part.num_rows)]
            more: list[list] = [[] for _ in range(part.num_rows)]
            sums = np.concatenate([[0], np.cumsum(interesting[buf])])
            people = pc.fill_null(pc.match_substring_regex(part.column("text"), _PEOPLE), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero((sums[offsets[1:]] > sums[offsets[:-1]]) | people):  # every span but a person's has a digit or an @
                text = buf[offsets[i] : offsets[i + 1]].tobytes().decode()
                own = base_spans(text)
                base[i] = [{"start": s, "kind": k, "end": e} for s, k, e in own]
                more[i] = [{"start": s, "kind": k, "end": e, "code": encode(k, *judge(text, s, k, e))} for s, k, e in candidates(text, own)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, base_type), pa.array(more, more_type)], ["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, base array<struct<start:long,kind:int,end:long>>, more array<struct<start:long,kind:int,end:long,code:long>>")


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (probability that each row is true, reliability by kind, labeler, truth and vote).

    Labelers err independently given the truth. Before anything is counted a labeler is taken to be right in two of three
    votes, with the weight of SMOOTH rows, so that the classes keep their meaning.
    """
    smooth = 4.0
    prior_votes = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]]) / 5  # (truth, vote)
    truth = 1 / (1 + np.exp(-1.0 * votes.sum(axis=1)))
    table = np.zeros((len(KINDS), votes.shape[1], 2, 3))
    for _ in range(rounds):
        for k in np.unique(kind):
            own = kind == k
            weight = np.stack([n[own] * (1 - truth[own]), n[own] * truth[own]])
            log = np.log((weight.sum(axis=1) + smooth) / (weight.sum() + 2 * smooth))[:, None] + np.zeros((2, own.sum()))
            for j in range(votes.shape[1]):
                seen = np.stack([weight[:, votes[own, j] == v].sum(axis=1) for v in (-1, 0, 1)], axis=1) + smooth * prior_votes
                table[k, j] = seen / seen.sum(axis=1, keepdims=True)
                log += np.log(table[k, j][:, votes[own, j] + 1])
            truth[own] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return truth, table


def design(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One column for each kind, for each value of a feature, and for each value within a kind."""
    values = np.concatenate([np.eye(m)[features[:, j]] for j, m in enumerate(FEATURES.values())], axis=1)
    kinds = np.eye(len(KINDS) - BASE)[kind - BASE]
    return np.concatenate([kinds, values, (kinds[:, :, None] * values[:, None, :]).reshape(len(kind), -1)], axis=1)


def train(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """Counts by code -> each code's probability by the span classifier, and the labelers' reliabilities."""
    codes = sorted(counts)
    if not codes:
        return {}, np.zeros((len(KINDS), len(LABELERS), 2, 3))
    n = np.array([counts[c] for c in codes], float)
    kind, votes, features = (np.array(x) for x in zip(*map(decode, codes), strict=True))
    truth, table = reliabilities(kind, votes, n)
    x = design(kind, features)
    used = x.any(axis=0)
    x = x[:, used]
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    ridge = 1e-5
    for _ in range(40):  # Newton steps of a ridge-regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.clip(np.linalg.solve(hess, x.T @ (weight * (truth - p)) - ridge * w), -4, 4)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True)), table


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in order; spans: with those the classifier adds."""
    found = cut(spans_of(docs), "pii")
    grouped = found.select(F.explode("more.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.code: r.n for r in grouped.collect()}  # combinations of votes and features, whatever the number of rows
    probability, _ = train(counts)
    taken = [c for c, p in probability.items() if p >= threshold]
    plus = F.transform(F.filter("more", lambda x: x["code"].isin(taken)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plus)).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in KINDS])

    def said(col: str):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", lambda x, k=k: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
