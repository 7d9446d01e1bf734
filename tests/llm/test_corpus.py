"""Corpus operators against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import _bytes, _joins, decontamination, jaccard, lm, packing, pii, quality, repeats

from .conftest import words

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def tokens(text):
    return SPACES.findall((text or "").translate(LOWER))


def shingle_set(text, width=5):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


# bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\t\n漢", max_size=12)), max_size=12), st.integers(1, 12))
def test_words_and_shingles(texts, limit):
    found = []
    for block in _bytes.blocks(pa.array(texts, pa.string()).slice(0), limit):
        w = block.words()
        raw = w.data.tobytes()
        found += [[raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.offsets[:-1], w.offsets[1:])]
        _, offsets = _bytes.shingles(w, 5)
        assert np.diff(offsets).tolist() == [len(shingle_set(t)) for t in texts[block.first : block.first + len(block)]]
    assert found == [tokens(t) for t in texts]


def test_sliding():
    x = np.random.default_rng(1).integers(0, 100, 50)
    for w in (1, 2, 5, 8, 13):
        assert _bytes.sliding(np.minimum, x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


# repeats


def brute_repeats(docs, length):
    at = collections.Counter(t[p : p + length] for _, t in docs for p in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if at[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, most, segment", [(1, repeats.MOST, repeats.SEGMENT), (2, 70, 90)])
def test_repeats(spark, monkeypatch, seed, most, segment):
    """Small limits: ranges and texts are split as those of many MB are."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(200)) for _ in range(5)]
    rows = []
    for k in range(120):
        t = "".join((lambda b: b[rng.randrange(100) : rng.randrange(100, 200)])(rng.choice(base)) if rng.random() < 0.6 else words(rng, 3) for _ in range(rng.randrange(5)))
        rows.append((k, rng.choice([t, t, t, "ab" * rng.randrange(60), "a" * rng.randrange(90), None])))
    rows += [(200, "abcde" * 150), (201, "x".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.repeated(df, length=40, gram=20).collect())
    assert got == sorted(brute_repeats([(i, (t or "").encode()) for i, t in rows], 40))


def test_repeats_on_odd_input(spark, odd_docs, no_docs):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated(odd_docs).collect())
    docs = [(r["doc_id"] or -1, (r["text"] or "").encode()) for r in odd_docs.collect()]
    assert got == sorted(brute_repeats(docs, 200)) and repeats.repeated(no_docs).count() == 0
    kept = repeats.repeated(odd_docs, with_kept=True)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in kept.collect())


def test_refinement_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(4)
        base = "".join(rng.choice("abcdef ") for _ in range(400))
        rows = [(k, base[rng.randrange(150) : rng.randrange(200, 400)]) for k in range(40)]
        got = sorted(tuple(r) for r in repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20).collect())
        assert got == sorted(brute_repeats([(i, t.encode()) for i, t in rows], 40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# language model


def test_lm_base(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    texts = {r["doc_id"]: [*tokens(r["text"]), None] for r in docs.collect()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in texts}
    c = collections.Counter(t for i, ts in texts.items() if train[i] for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in texts.items():
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"])
    assert lm.score(no_docs).count() == 0


def brute_lm(rows):
    """(score of each text, depth of the tree) from the definition, and the probability of a word after a context."""
    texts = [(zlib.crc32(str(i).encode()) % 10 != 0, [*tokens(t), None]) for i, t in rows]
    n = collections.Counter(tuple(ts[k : k + g]) for train, ts in texts if train for g in range(1, 12) for k in range(len(ts) - g + 1))
    total, v = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    states, memory = {(): 1.0}, {}

    def counted(g):
        return len(g) < 3 or counted(g[:-1]) and counted(g[1:]) and g[1:-1] in states

    def p(c, w):
        if not c:
            return (n[(w,)] + 0.1) / (total + 0.1 * (v + 1))
        if c not in states:
            return p(c[1:], w)
        if (c, w) not in memory:
            shown = (n[(*c, w)] - 0.5) / n[c] if n[(*c, w)] >= lm.LEAST else 0
            memory[c, w] = shown + states[c] * p(c[1:], w)
        return memory[c, w]

    for depth in range(1, 10):
        new, after = {}, collections.defaultdict(list)
        for g in n:
            if len(g) == depth + 1 and n[g] >= lm.LEAST:
                after[g[:-1]].append(g[-1])
        for c, following in after.items():
            if c[1:] in states and counted(c):
                shown = {w: (n[(*c, w)] - 0.5) / n[c] for w in following}
                rest, parent = max(1 - sum(shown.values()), 1e-12), {w: p(c[1:], w) for w in following}
                gain = sum((x + rest * parent[w]) * math.log((x + rest * parent[w]) / parent[w]) for w, x in shown.items())
                if n[c] * (gain + rest * math.log(rest) * max(1 - sum(parent.values()), 0)) >= lm.GAIN:
                    new[c] = rest
        if not new:
            break
        states.update(new)
    scores = [sum(math.log10(p(tuple(ts[max(0, k - 9) : k]), w)) for k, w in enumerate(ts)) for _, ts in texts]
    return scores, max(map(len, states)), p, [g[0] for g in n if len(g) == 1]


@pytest.mark.parametrize("chunk, bucket, deep", [(500_000, 1_000_000, 9), (150, 40, 2)])
def test_lm_is_the_suffix_tree_of_the_definition(spark, monkeypatch, chunk, bucket, deep):
    """Contexts of any length, in one chunk and in many, with unseen words, ties and rows that repeat an id."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "BUCKET_KEYS", bucket)
    rng = random.Random(4)
    passages = [words(rng, 30, 14).split() for _ in range(8)]
    rows = [(k, " ".join(w if rng.random() < 0.97 else f"rare{rng.randrange(300)}" for w in rng.choice(passages)[rng.randrange(12) :])) for k in range(240)]
    rows += [(7, "w1 w2 w3 w1 w2 w3"), (9_000, None), (9_001, "unseen WORDS w1")]
    scores, depth, p, vocabulary = brute_lm(rows)
    assert depth >= 3
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), deep).collect()
    assert {r["depth"] for r in got} == {depth} and len(got) == len(rows)
    assert sorted((r["doc_id"], round(r["score"], 8)) for r in got) == sorted((i, round(x, 8)) for (i, _), x in zip(rows, scores))
    assert sum(r["score"] for r in got if r["held_out"]) > 0.8 * sum(r["base_score"] for r in got if r["held_out"])  # nearer to 0: order helps
    for context in [(), *(tuple(passages[0][k : k + g]) for k in (0, 5) for g in (1, 2, 3, 5))]:
        assert sum(p(context, w) for w in vocabulary) + p(context, "never seen") == pytest.approx(1, abs=1e-9)


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1-+ (2é_\n", max_size=40))
def test_base_spans(text):
    assert [x[:3] for x in pii.base_spans(text)] == plain_spans(text)


def test_base_spans_known():
    text = "é mail a.b@c.de_x@d.ef, 1.2.3.4.5 256.1.1.1 007.0.0.1 4111-1111 1111 1111 +49 (30) 1234-5678 +1"
    assert [x[:3] for x in pii.base_spans(text)] == plain_spans(text)
    assert pii.base_spans("1" * 50_000 + "@" + "a" * 50_000) == []  # long runs take no longer than their length


def private(spark):
    rng = random.Random(9)
    rows = [(k, f"{words(rng, 30)} the {'' if k % 3 else 'zanzibarian'} smith mailed joe{k % 3}@x.example about it {words(rng, 30)}") for k in range(30)]
    rows += [(100 + k, words(rng, 60) + " the about it mailed smith") for k in range(170)]
    return spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, base string, uid int").repartition(4)


def test_terms(spark):
    df = private(spark)
    out = {r["doc_id"]: r for r in pii.spans(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for i, r in out.items():
        base = plain_spans(texts[i])
        told = ",".join(f"{k}:{s}:{f}" for k, s, f in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"].startswith(told) and r["n_email"] == len(base)
        terms = [texts[i][int(s) : int(f)] for k, s, f in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"]
        assert {"zanzibarian"} <= set(terms) <= {"zanzibarian", "joe"} if i < 30 and i % 3 == 0 else not terms
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    new = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("[EMAIL]" in new[i] and "@" not in new[i] for i in range(30)) and all(new[i] == texts[i] for i in texts if i >= 100)


def brute_terms(rows):
    """(row, start, end, remove) of disclosing terms, from the definition."""
    terms, entities = [], []
    for _, text in rows:
        base = [(s, f) for _, s, f in plain_spans(text)]
        entities.append({(k, v) for k, _, _, v in pii.base_spans(text)})
        block = _bytes.Block(0, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        start, end, _, data, _ = _bytes.units(block)
        raw, found = data.tobytes(), []
        for s, f in zip(start.tolist(), end.tolist()):
            word = raw[s:f].decode()
            a = len(raw[:s].decode())
            if f - s >= 3 and (word[0].isascii() and word[0].isalpha() or ord(word[0]) > 127 or re.search("[0-9]", word)):
                found.append((word, a, a + len(word), any(a < y and x < a + len(word) for x, y in base)))
        terms.append(found)
    n, out = len(rows), set()
    df = collections.Counter(t for x in terms for t in {t for t, *_ in x})
    df_e = collections.Counter(e for x in entities for e in x)
    both = collections.Counter((e, t) for x, y in zip(entities, terms) for e in x for t in {t for t, *_ in y})

    def told(e, t, p):
        return both[e, t] > df[t] * p + 1.96 * (df[t] * p * (1 - p)) ** 0.5

    for k, (x, y) in enumerate(zip(entities, terms)):
        for t, s, f, inside in y:
            of = [e for e in x if told(e, t, max(1 / 3, (df_e[e] / n) ** 0.5))]
            if of and not inside:
                out.add((k, s, f, any(told(e, t, max(2 / 3, (df_e[e] / n) ** 0.25)) for e in of)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_term_shares(spark, seed):
    """Disclosing terms are those of the definition, in copies, near copies and long lists too."""
    rng = random.Random(seed)
    person = lambda k: f"joe{k}@x.example"
    rows = []
    for k in range(12):
        own = f"name{k} {rng.choice(['alpha', 'beta'])}{k}"
        rows += [f"{words(rng, 25)} {own} wrote {person(k)} {words(rng, 9)} {own if rng.random() < 0.5 else ''}" for _ in range(rng.randrange(1, 14))]
    rows += [" ".join(f"{person(k)} entry{k}" for k in range(40))] * 2 + [f"entry{k} {words(rng, 5)} {person(k)}" for k in range(0, 40, 3)]
    rows += [f"{words(rng, 30)} name{rng.randrange(12)} office@x.example" for _ in range(60)] + [words(rng, 50) for _ in range(60)] + rows[:5] * 3
    rows = list(enumerate(rows))
    want = brute_terms(rows)
    assert {r for *_, r in want} == {True, False}
    got = {r["doc_id"]: {tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")} for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: {(s, f) for i, s, f, _ in want if i == k} for k, _ in rows}
    new = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(new[k] == pii.replaced(t, pii.base_spans(t), [{"s": s, "f": f, "remove": r} for i, s, f, r in want if i == k]) for k, t in rows)


def test_terms_are_found_in_the_tables(spark):
    found = pii.spans(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("spans like '%term:%'").count()
    assert found > 0


@pytest.mark.parametrize("unit", ["1", "1 ", "4111 1111 1111 1111 ", "joe.{}@x.example "])
def test_long_texts_full_of_digits_or_addresses(unit):
    """Read by pieces: terms and places are those of the whole text."""
    text = "".join(unit.format(k) for k in range(4_000_000 // len(unit)))
    block = next(_bytes.blocks(pa.array([text])))
    assert len(list(pii._pieces(block))) > 2 and b"".join(p.data.tobytes() for p in pii._pieces(block)) == text.encode()
    if " " in unit:
        assert np.array_equal(np.unique(pii._terms(block)[0]), pii._distinct_terms(block)[0])
    assert sum(1 for _ in pii._scan(text)) == (0 if unit.startswith("1") else text.count("@") if "@" in unit else 0)


def test_terms_go_wherever_they_stand(spark):
    """A revealing term is found far from the entity too, in every document that holds it, and may be a number."""
    rng = random.Random(2)
    rows = [(k, f"zanzibarian 4711-88 {words(rng, 30)} case 4711-88 zanzibarian joe@x.example {words(rng, 30)} zanzibarian é 4711-88") for k in range(5)]
    rows += [(9, f"joe@x.example {words(rng, 40)} zanzibarian")] + [(100 + k, words(rng, 60)) for k in range(200)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    out, texts = pii.spans(df).collect(), dict(rows)
    assert len(out) == len(rows) + 1
    for r in out:
        got = [(int(s), int(f)) for k, s, f in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"]
        want = [m.span() for m in re.finditer("zanzibarian|4711-88", texts[r["doc_id"]])]
        assert [p for p in got if p in want] == want
    new = pii.sanitise(df).where("doc_id < 10").collect()
    assert len(new) == 7 and not any(w in r["text"] for r in new for w in ("zanzibarian", "4711-88", "joe"))


def _hash_of(word):
    block = next(_bytes.blocks(pa.array([word])))
    start, end, _, data, _ = _bytes.units(block)
    return _bytes.Rolling(data).of(start, end).view(np.int64)[0]


def test_pii_on_odd_input(odd_docs, no_docs):
    out = pii.spans(odd_docs).collect()
    assert len(out) == odd_docs.count() and {r["n_phone"] for r in out if r["doc_id"] == 9} == {1}
    assert pii.spans(no_docs).count() == 0 and pii.sanitise(no_docs).count() == 0
    new = {r["doc_id"]: r for r in pii.sanitise(odd_docs).collect()}
    assert new[0]["text"] is None and new[9]["text"].endswith("[EMAIL] [PHONE]") and new[3]["row"] == "r"


# Jaccard join


def brute_link(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            inner = len(a & b)
            if inner and 100 * inner >= 75 * (len(a) + len(b) - inner):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_docs(seed, n=150):
    rng, rows = random.Random(seed), []
    passage = words(rng, 25, 10_000)
    bases = [words(rng, rng.randrange(3, 200), 10_000).split() for _ in range(12)]
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        if rng.random() < 0.3:
            w += passage.split()
        rows.append((k, " ".join(w) if rng.random() < 0.9 else " ".join(w).upper().replace(" ", "\n")))
    return rows


@pytest.mark.parametrize("seed, local", [(1, 64), (2, 2), (3, 2)])
def test_links(spark, monkeypatch, seed, local):
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = near_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.link(df).collect()) == brute_link(rows)


def test_sketch_bounds():
    rng = random.Random(5)
    for _ in range(30):
        a = words(rng, 60).split()
        b = a[: rng.randrange(60)] + words(rng, 20).split()
        values, offsets = _bytes.shingles(next(_bytes.blocks(pa.array([" ".join(a), " ".join(b)]))).words(), 5)
        bits = [int.from_bytes(x, "big") for x in jaccard.bit_sketches(values, offsets)]
        apart = len(set(values[: offsets[1]].tolist()) ^ set(values[offsets[1] :].tolist()))
        assert bin(bits[0] ^ bits[1]).count("1") <= apart


def test_links_on_odd_input(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null").collect()]
    want = {i: (n, c) for i, n, c in brute_link([(i, t) for k, (i, t) in enumerate(rows) if i not in [x for x, _ in rows[:k]]])}
    got = jaccard.link(odd_docs).collect()
    assert len(got) == len(rows) and all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got)
    assert jaccard.link(no_docs).count() == 0 and jaccard.kept(no_docs).count() == 0
    kept = [r["doc_id"] for r in jaccard.kept(odd_docs).collect()]
    assert kept.count(None) == 2 and 6 not in kept and kept.count(5) == 1  # equal rows are copies


def test_rows_that_repeat_an_id(spark, monkeypatch):
    """Rows of one id with other texts are documents of their own: no text is lost, and one row of each group stays."""
    monkeypatch.setattr(jaccard, "SPOKES", 1)
    monkeypatch.setattr(_joins, "BROADCAST_ROWS", 2)
    rng = random.Random(3)
    a, b, c = words(rng, 40), words(rng, 40), words(rng, 40)
    rows = [(5, a), (5, b), (3, a), (7, b), (9, a + " more"), (5, c), (5, c), (6, c.upper()), (11, ""), (11, ""), (12, "x"), (12, "X")] + [(20 + k, f"{a} w{k}") for k in range(40)]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "doc_id long, text string, c2 string, n long").repartition(3)
    kept = sorted((r["doc_id"], r["text"].lower()) for r in jaccard.kept(df).collect())
    assert kept == sorted([(3, a), (5, b), (5, c), (11, ""), (11, ""), (12, "x")])
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.link(df).collect())
    assert got == sorted([(5, 3), (5, 5), (3, 3), (7, 5), (9, 3), (5, 5), (5, 5), (6, 5), (11, 11), (11, 11), (12, 12), (12, 12)] + [(20 + k, 3) for k in range(40)])


# packing


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(odd_docs, TOKENIZER).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    by_window, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_window[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0
    assert set(by_doc) == set(texts)
    for i, found in by_doc.items():
        ids = texts[i][0]
        assert sum(p["length"] for p in found) == sum(map(len, texts[i]))
        if len(texts[i]) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
    assert packing.pack(no_docs, TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([1, 200, 700, 10**9]))
def test_packer(sizes, most):
    packer = packing.Packer(16, 0, most)
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype=np.uint32) + 1000 * k)
        assert packer.held == sum(len(p[2]) + packing.PIECE for windows in packer.at for w in windows for p in w)
    packer.flush()
    at, filled = collections.Counter(), collections.Counter()
    for doc, start, length, crc, n, sequence, offset in sorted(packer.rows, key=lambda r: (r[0], r[1])):
        assert start == at[doc] and n == sizes[doc]
        assert crc == zlib.crc32((np.arange(start, start + length) + 1000 * doc).astype("<u4").tobytes())
        at[doc] += length
    for r in sorted(packer.rows, key=lambda r: (r[5], r[6])):
        assert r[6] == filled[r[5]]
        filled[r[5]] += r[2]
    assert [at[k] for k in range(len(sizes))] == sizes
    assert all(n <= 16 and n & (n - 1) == 0 for n in filled.values()) and sum(n < 16 for n in filled.values()) <= 4


def test_most_ids_stay_where_the_squares_place_them():
    sizes = np.random.default_rng(3).lognormal(np.log(500), 0.8, 4000).astype(int) + 1
    shares = []
    for most in (packing.HELD, 400_000):
        packer = packing.Packer(most=most)
        for k, n in enumerate(sizes.tolist()):
            packer.add(k, np.zeros(n, np.uint32))
            assert packer.held <= most
        packer.flush()
        assert sum(r[2] for r in packer.rows) == sizes.sum()
        shares.append(packer.cut / sizes.sum())
    print(shares)
    assert max(shares) < 0.3


def test_sum_of_squares_choice():
    packer = packing.Packer(10)
    for n in (6, 6, 6, 4):
        packer.place((0, 0, np.zeros(n, np.uint32), n))
    assert packer.count[6] == 2 and len(packer.rows) == 2  # three windows at 6 are thinned by the 4


def test_units_encode_like_whole_texts():
    texts = ["Don't STOP!! it's... <|endoftext|> a.b,c $$$ 'tis O'Brien's", "héllo wörld x 漢字 1234 a1b2", "", "ÀÉ. İstanbul ΣΑΣ. x‍y", "a" * 500]
    encoder = packing.WordEncoder(TOKENIZER)
    for block in _bytes.blocks(pa.array(texts)):
        ids, offsets = encoder.encode(block, 2)
        assert [ids[a : b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# quality


def test_quality_held_out():
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas()
    rows = docs.merge(labels, on="doc_id").sample(frac=1, random_state=3)
    grade = np.where(rows["toxic"] == 1, 0, np.where(rows["quality"] == 0, 1, 2))
    cut = len(rows) * 4 // 5

    def featured(texts):
        keys, offsets = [], [0]
        for block in _bytes.blocks(pa.array(texts)):
            k, o = quality.features(block)
            keys.append(k)
            offsets += (o[1:] + offsets[-1]).tolist()
        return np.concatenate(keys), np.array(offsets)

    model = quality.fit(*featured(rows["text"][:cut]), grade[:cut])
    assert model.theta[0] < model.theta[1]
    keep = (model.below(quality.latent(model.weights, *featured(rows["text"][cut:]))) < 0.5).all(axis=1)
    share = [keep[grade[cut:] == g].mean() for g in range(3)]
    assert share[0] <= 0.06 and share[1] <= 0.1 and share[2] >= 0.97, share


def test_quality_on_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0, 1) for k in range(40)] + [(None, 1, 0, 1), (1, None, None, 1), (9999, 1, 0, 1)], "doc_id long, quality int, toxic int, n int")
    model = quality.train(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_good"] <= 1 for r in out)
    assert quality.kept(odd_docs, labels).columns == odd_docs.columns
    assert quality.kept(odd_docs, labels.limit(0)).count() == odd_docs.count() and quality.kept(no_docs, labels).count() == 0


# decontamination


def brute_contaminated(docs, items):
    held = {}
    for j, t in items:
        if j is not None:
            held.setdefault(j, set()).update(shingle_set((t or "").lower()))
    texts = {}
    for i, t in docs:
        if i is not None:
            texts.setdefault(i, set()).update(shingle_set((t or "").lower()))
    return sorted((i, j, len(s), len(s & d)) for i, d in texts.items() for j, s in held.items() if s and 4 * len(s & d) >= 3 * len(s))


def test_the_sketch_saves_work(spark):
    """Fewer than half of the rows that all shingles of the items would join are looked up, and no candidate is missed."""
    rng = random.Random(7)
    items = [(k, words(rng, 44, 5000)) for k in range(40)]
    docs = [(k, " ".join([words(rng, 50, 5000), *(t for _, t in rng.sample(items, 3)), " ".join(rng.choice(items)[1].split()[:20])])) for k in range(100)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), decontamination.sketched(spark.createDataFrame(items, "item_id long, text string"))
    sketch = known.where("in_sketch").select("h", "item_id")
    some, every = (decontamination.probed(df, x.select("h", "item_id"), True) for x in (sketch, known))
    assert 0 < 2 * some.count() < every.count() and {r["n"] for r in sketch.groupBy("item_id").count().select(F.col("count").alias("n")).collect()} == {11}
    found = {(i, j) for i, j, *_ in brute_contaminated(docs, items)}
    assert found <= {(r["doc_id"], r["item_id"]) for r in some.collect()} and found


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_contaminated(spark, odd_docs, no_docs, broadcast_rows):
    rng = random.Random(12)
    items = [(k, words(rng, rng.randrange(1, 40), 5000)) for k in range(30)] + [(90, None), (91, ""), (None, "one"), (92, "one"), (93, "One ONE one"), (3, words(rng, 9))]
    rows = [(1000 + k, words(rng, 40, 5000) + " " + " ".join((lambda w: w[: max(1, len(w) - rng.randrange(8))])(items[k % 30][1].upper().split())) + " " + words(rng, 40, 5000)) for k in range(60)]
    df = odd_docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long"))
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, h long, need int")
    got = sorted(tuple(r) for r in decontamination.contaminated(df, bench, broadcast_rows=broadcast_rows).collect())
    assert got == brute_contaminated([(r["doc_id"], r["text"]) for r in df.collect()], items) and got
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.contaminated(no_docs, bench).count() == 0
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(r["doc_id"] not in {g[0] for g in got} for r in df.collect())
