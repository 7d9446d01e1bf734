"""Top-k search, chat formatting and archives."""

import io
import itertools
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import chat, topk, warc


def brute_top(rows, k):
    q = {}
    out = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, []).append([int(np.floor(1024.0 * x)) for x in v])
    for i in q:
        if i % 100 == 0:
            mine = min(q[i])
            scored = sorted(((-sum(a * b for a, b in zip(mine, w)), j) for j, vs in q.items() if j != i for w in vs if len(w) == len(mine)))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=24)]) for k in range(400)]
    rows[7] = (7, list(rows[5][1]))  # a tie
    rows += [(1000, None), (1100, []), (1200, [float("nan")] * 24), (1300, [None] * 24), (1400, [float("inf")] * 24), (1500, [1.0] * 8), (1501, [0.5] * 8), (None, [1.0] * 24), (300, rows[300][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {i: v for i, v in brute_top(rows, 10).items() if v}
    assert got == want and 1500 in got and topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e11, 1.0]), (1, [3e11, 2.0]), (2, [3e11, 3.0]), (3, [1e17, 1e17])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(k, (1 << 63) - 1) for k in (1, 2, 3)]  # saturated, so ties go to the smaller id
    rows = [(0, [2e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, 3.0]), (3, [-2e6, 0.5])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    whole = int(2e6 * 1024)
    assert [(r["vec_id"], r["score"]) for r in out] == [(2, whole**2 + 3 * 1024**2), (1, whole**2 + 2 * 1024**2), (3, -(whole**2) + 512 * 1024)]


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=6)]) for k in range(60)], "vec_id long, embedding array<double>")
    one = sorted(topk.top_k(df, F.col("vec_id") % 2 == 0, 4).collect())
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert sorted(topk.top_k(df, F.col("vec_id") % 2 == 0, 4).collect()) == one


def best_cost(roles):
    best = chat.FAR
    for path in itertools.product((1, 2, 3), repeat=len(roles)):
        state, cost = 0, 0
        for r, t in zip(roles, path):
            cost += chat.step_cost(r, state, t)[0]
            state = t
        best = min(best, cost + (chat.INSERT * len(chat.CLOSING[state]) if roles else 0))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([None, 1, 2, 3]), min_size=1, max_size=6))
def test_repair_is_cheapest(roles):
    costs = chat.to_go(roles, chat.END_COSTS)
    text, cost, merged, changed, added = chat.render(roles, ["t"] * len(roles), 0, costs, True)
    assert cost == best_cost(roles) == costs[0][0]
    kinds = [x.split("\n", 1)[0] for x in text.split("<|im_start|>")[1:]]
    tail = kinds[1:] if kinds[:1] == ["system"] else kinds
    assert len(tail) % 2 == 0 and all(k == ("user", "assistant")[i % 2] for i, k in enumerate(tail)) and len(kinds) == len(roles) - merged + added


def conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "human", "tool", None]), rng.choice(["", "a", "bb", None]), "s") for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, ["user", "assistant", "user"][t % 3], f"t{t}", "s") for t in range(300)]  # a long one
    rows += [(60, 0, "user", "x", "s")] * 3 + [(61, None, "user", "n", "s"), (61, 0, "assistant", "m", "s"), (None, 0, "user", "lost", "s")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg string")


def rendered(df, segment):
    out = {}
    for r in chat.formatted(df, segment).orderBy("conv_id", "chunk").collect():
        text, cost = out.get(r["conv_id"], ("", 0))
        out[r["conv_id"]] = (text + r["text"], cost + r["cost"])
    return out


def test_segments_do_not_matter(spark):
    df = conversations(spark)
    whole = rendered(df, 512)
    assert rendered(df.repartition(5), 3) == whole
    assert None not in whole and whole[60][0].count("<|im_start|>user") == 1 and whole[61][0].startswith("<|im_start|>user\nn<|im_end|>")
    assert whole[50][0].count("t299") == 1 and chat.formatted(df.limit(0)).count() == 0


def test_clean_conversation():
    roles = [1, 2, 3]
    out = chat.render(roles, ["s", "u", "a"], 0, chat.to_go(roles, chat.END_COSTS), True)
    assert out == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n", 0, 0, 0, 0)


def test_round_trip(spark):
    big = "<p>" + "x" * 300_000 + "</p>"
    pages = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "héé"), (7, "u", big), (7, "u", big), (None, "u", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, sha1 string").repartition(3)
    out = {(r["page_id"]): r for r in warc.round_trip(df).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7] and warc.round_trip(df).count() == 8
    assert (out[3]["record_type"], out[3]["refers_to"], bytes(out[3]["payload"])) == ("response", None, b"same")
    assert (out[1]["record_type"], out[1]["refers_to"], out[1]["payload"]) == ("revisit", 3, None) and out[2]["refers_to"] == 3
    assert out[4]["refers_to"] == 5 and out[5]["payload_bytes"] == 0 and out[6]["payload_bytes"] == 5 and bytes(out[7]["payload"]) == big.encode()
    assert out[6]["payload_digest"] == warc.digest("héé".encode()) and len(out[6]["payload_digest"]) == 32
    least = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least=5).collect()}
    assert least[1] == least[4] == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(zip64, monkeypatch):
    plain = warc.ZipWriter
    monkeypatch.setattr(warc, "ZipWriter", lambda out: plain(out, zip64))
    out, lines = io.BytesIO(), []
    rows = [(k, "u", b"x" * k, warc.digest(b"x" * k), None, k) for k in range(200)]
    warc._write_archive(out, iter(rows), lines)
    import pyarrow as pa

    back = list(warc.read_archive(pa.BufferReader(out.getvalue())))
    assert [(r[0], r[1], r[2], r[6]) for r in back] == [(k, k, warc.digest(b"x" * k), b"x" * k) for k in range(200)]
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:  # another reader agrees
        assert z.testzip() is None and sorted(z.namelist()) == [warc.DATA, warc.INDEX]


def test_foreign_archive():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"c" * 300
        z.writestr("a.txt", b"abc")
        z.writestr(zipfile.ZipInfo("packed"), b"z" * 100, zipfile.ZIP_DEFLATED)
    reader = warc.in_memory(buffer.getvalue())
    assert reader.read("a.txt") == b"abc" and reader.range(reader.start("a.txt"), 1, 1) == b"b" and "packed" not in reader.members
    with pytest.raises(ValueError):
        warc.in_memory(b"no archive")
    with pytest.raises(ValueError):
        warc.parsed(b"HTTP/1.1\r\n\r\n")
