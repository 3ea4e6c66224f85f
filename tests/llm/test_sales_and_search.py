"""Operators 11, 12, 13."""

import base64
import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rasterloom.llm import bisection, concurrency, queries, rank_bpe, search
from tests.conftest import DATA

# ---- operator 11

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, nation_id int, key string"
LINES = "sale_id long, shipped_at timestamp_ntz, at string, n_open int"
CLIENTS = "client_id long, nation_id int, chunk string"


def test_op11(spark, same_rows):
    same_rows(queries.op11_open_sales(spark, DATA), queries.oracle_sql()["op11_open_sales"])


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def brute_sales(sales, lines, clients):
    epoch = dt.datetime(1970, 1, 1)
    minute = lambda t: (t - epoch) // dt.timedelta(minutes=1) * 60
    first, nation = {}, {}
    for sale, shipped, *_ in lines:
        if sale is not None and shipped is not None:
            first[sale] = min(first.get(sale, 1 << 60), minute(shipped))
    for client, n, *_ in clients:
        if client is not None and n is not None:
            nation[client] = min(nation.get(client, 1 << 30), n)
    moves = {}
    for sale, client, _, total, sold, *_ in sales:
        if sold is None:
            continue
        start, end = minute(sold), first[sale] + 7 * 86400 if sale in first else None
        if end is not None and end <= start:
            continue
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else 0
        for n in (nation.get(client, -1), -2):
            for t, sign in ((start, 1), (end, -1)):
                if t is not None:
                    x = moves.setdefault(n, {}).setdefault(t, [0, 0])
                    x[0] += sign
                    x[1] += sign * cents
    out = []
    for n, moments in moves.items():
        times = [t for t in sorted(moments) if moments[t] != [0, 0]]
        count = cents = 0
        high, rows = -1, []
        for t, after in zip(times, [*times[1:], None]):
            count, cents = count + moments[t][0], cents + moments[t][1]
            high = max(high, count)
            rows.append((n, t, after, count, cents, high))
        peak = max((r[4] for r in rows), default=0)
        out += [(*r, r[4] == peak) for r in rows]
    return sorted(out)


def told(frame):
    return sorted((r["nation_id"], r["from_s"], r["to_s"], r["n_open"], r["open_cents"], r["high_open"], r["is_peak"]) for r in frame.collect())


def frames(spark, sales, lines, clients):
    return spark.createDataFrame([(*s, 5, "k") for s in sales], SALES), spark.createDataFrame([(*x, "a", 1) for x in lines], LINES), spark.createDataFrame([(*c, "c") for c in clients], CLIENTS)


def test_odd_sales(spark):
    """Nulls in every column, equal and broken times, negative and odd totals, repeated rows of every table."""
    sales = [
        (1, 10, "x", 5.005, at(0)), (1, 10, "x", 5.005, at(0)), (2, 10, None, None, at(3, 59)), (3, None, "x", -2.5, at(3)), (None, 11, "x", 1.0, at(4)),
        (4, 99, "x", float("nan"), at(5)), (5, 11, "x", 1.0, None), (6, 11, "x", 7.0, at(20_000)), (7, 12, "x", float("inf"), at(6)), (8, 12, "x", 1.0, at(7 * 1440 + 30, 30)),
        (9, 12, "x", 2.0, dt.datetime(1969, 12, 31, 23, 59, 30)), (None, None, None, None, None),
    ]
    lines = [(1, at(100)), (1, at(90, 59)), (1, None), (2, at(10)), (6, at(5)), (8, at(30)), (None, at(1)), (50, at(2)), (None, None)]
    clients = [(10, 3), (10, 3), (11, None), (12, 4), (12, 2), (None, 7)]
    assert told(concurrency.open_sales(*frames(spark, sales, lines, clients))) == brute_sales(sales, lines, clients)


def test_carries_between_chunks(spark, monkeypatch):
    monkeypatch.setattr(concurrency, "CHUNK", 64)
    rng = random.Random(3)
    sales = [(k, 1 if k % 3 else rng.randrange(6), "x", rng.choice([None, rng.randrange(-500, 5000) / 100]), at(rng.randrange(3000))) for k in range(400)]
    lines = [(rng.randrange(500), at(rng.randrange(-9000, 4000))) for _ in range(600)]
    clients = [(k, k % 4 or None) for k in range(5)]
    assert told(concurrency.open_sales(*frames(spark, sales, lines, clients))) == brute_sales(sales, lines, clients)


def test_empty_sales(spark):
    sales, lines, clients = frames(spark, [(1, 1, "x", 1.0, at(0))], [(1, at(0))], [(1, 1)])
    assert concurrency.open_sales(sales.limit(0), lines, clients).count() == 0
    assert told(concurrency.open_sales(sales, lines.limit(0), clients.limit(0))) == brute_sales([(1, 1, "x", 1.0, at(0))], [], [])


def test_times_with_and_without_a_zone(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:59' AS a, timestamp'2024-03-31 02:30:59+00:00' AS b, timestamp_ntz'1969-12-31 23:59:59.5' AS c")
    assert tuple(frame.select(concurrency.seconds(frame, "a"), concurrency.seconds(frame, "b"), concurrency.seconds(frame, "c")).first()) == (1711852200, 1711852200, -60)


# ---- operator 12

RANKS = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op12(spark, documents):
    library = reference()
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_rank_bpe(spark, DATA).collect()}
    assert found == {d: digests(t, library) for d, t in documents}


def test_ranks_of_odd_documents(spark, odd_docs, odd_texts, no_docs):
    library = reference()
    found = rank_bpe.rank_digests(odd_docs, RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()} == {d: digests(t, library) for d, t in odd_texts}
    assert rank_bpe.rank_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    twice = rank_bpe.encode_texts(odd_docs.withColumn("ids", odd_docs.n_chars), RANKS, public_tokenizers.PATTERN)
    assert twice.columns == ["doc_id", "lang", "source", "n_chars", "start", "removed", "score", "ids"]
    row = twice.where("doc_id = 5").first()
    assert (row["removed"], row["source"], row["score"]) == ("clash", "b", 1.5)
    same = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c d e"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rank_bpe.rank_digests(same, RANKS, public_tokenizers.PATTERN).collect()) == sorted([(0, 2), (1, 2), (1, len(library.encode_ordinary("c d e"))), (1, 0)])


def test_cut_texts_have_the_same_ids(monkeypatch):
    monkeypatch.setattr(rank_bpe, "PART", 20)
    monkeypatch.setattr(rank_bpe, "RUN", 6)
    monkeypatch.setattr(rank_bpe, "RUNS", re.compile(f"[{rank_bpe.WHITE}]{{6,}}"))
    library, own = reference(), rank_bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    pieces = ["it's", "'S", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "\x1c", "​", "word", "é", "漢字", "😀", ".", ",", "12", "½", "'", "'s"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) * rng.choice([1, 1, 1, 2, 8]) for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_very_long_runs():
    """White space on which the library's regular expressions give up: the same ids as shorter runs', match by match."""
    library, own = reference(), rank_bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    n = 1_500_000
    with pytest.raises(ValueError):
        library.encode(" " * n)
    for text in (" " * n, "a" + " " * n + "b", "\n" * n + "x", "x" * 300_000):
        assert own.decode(own.encode(text)) == text.encode()
    inner = np.frombuffer(own.encode("a" + " " * n + "b"), "<u4").tolist()
    assert inner[0] == library.encode_ordinary("a")[0] and inner[-1:] == library.encode_ordinary(" b") and inner[1:-1] == library._encode_single_piece(" " * (n - 1))


def test_unknown_ids():
    with pytest.raises(ValueError):
        rank_bpe.tokenizer(RANKS, public_tokenizers.PATTERN).decode(np.array([60_000], "<u4").tobytes())


# ---- operator 13


def test_op13(spark, same_rows):
    same_rows(queries.op13_ranked_search(spark, DATA), queries.oracle_sql()["op13_ranked_search"])


def words(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))]


def brute_search(docs, items, top=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    count, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    texts = {}
    for i, t in items:
        if i is not None:
            texts.setdefault(i, Counter()).update(words(t))
    out = []
    for i, wanted in texts.items():
        scored = []
        for d, b in bags:
            m = 100 - 75 + 75 * b.total() * count // length
            s = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w, k in wanted.items() if w in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def hits(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def test_search_of_odd_documents(spark, odd_docs, odd_texts, no_docs):
    items = [(1, "the quick brown fox"), (2, "LOREM ipsum é 漢字 中文字符"), (3, None), (4, ""), (5, "... --"), (6, "zzzunknown"), (None, "fox"), (1, "lazy dog dog"), (7, "b a"), (8, "x" * 30000)]
    frame = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, rank int")
    assert hits(search.ranked(odd_docs, frame)) == brute_search(odd_texts, items)
    assert search.ranked(no_docs, frame).count() == 0 and search.ranked(odd_docs, frame.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_search_through_many_blocks(spark, monkeypatch, small):
    """Several ranges, shards, blocks, clusters and blocks of items; repeated ids, ties, and a third of all rows alike."""
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "CLUSTER", 8)
    monkeypatch.setattr(search, "ITEM_TERMS", 30)
    monkeypatch.setattr(search, "WIDTHS", (1, 2) if small else (1, 8, 64))
    rng = random.Random(5)
    topics = [[f"w{rng.randrange(80)}" for _ in range(12)] for _ in range(9)]
    docs = [(k // 2 if k % 5 == 0 else k, " ".join(rng.choice(rng.choice(topics) if rng.random() < 0.2 else topics[k % 9]) for _ in range(rng.randrange(1, 25)))) if k % 3 else (k, "alpha beta w1 w2") for k in range(700)]
    docs += [(None, "alpha beta"), (None, "gamma w1"), (800, "Alpha, BETA! alpha; " + "filler " * 3000)]
    items = [(k, " ".join(rng.choice(rng.choice(topics)) for _ in range(6))) for k in range(12)] + [(50, "alpha beta"), (51, "gamma"), (52, "filler w5 w5")]
    found = search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert hits(found) == brute_search(docs, items)


def test_terms_of_cut_texts(monkeypatch):
    whole = search.bags(pa.array(["Ab c9 ab", None, "", "é-ab", "x" * 5000 + " y", "c c c"]))
    monkeypatch.setattr(search, "PART", 3)
    cut = search.bags(pa.array(["Ab c9 ab", None, "", "é-ab", "x" * 5000 + " y", "c c c"]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and whole[2].tolist().count(3) == 1


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 64))
    owner = np.repeat(np.arange(512), 20)
    term = topic[owner] * 40 + rng.integers(0, 40, len(owner))
    pairs = np.unique(np.stack([owner, term]), axis=1)
    now = bisection.order(*pairs, 512, 64)
    assert sorted(now.tolist()) == list(range(512))
    mixed = lambda order: sum(len(set(topic[order[a : a + 64]].tolist())) for a in range(0, 512, 64))
    assert mixed(now) <= 20 and mixed(np.arange(512)) >= 60
    weights = bisection.tree(*pairs, 512, 3, 320)
    of = bisection.leaves(*pairs, 512, weights)
    assert np.mean([np.bincount(of[topic == t], minlength=8).max() / 64 for t in range(8)]) > 0.8


def test_cluster_bounds_hold():
    texts = pa.array([f"a{k % 7} b{k % 11} " * (k % 5 + 1) for k in range(300)])
    name, docs, *parts = search.block_row("x", pa.array(range(300), pa.int64()), texts, 300, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([name, docs.to_pylist(), *parts], [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 7])], names=[x.split()[0] for x in search.INDEX.split(", ")])
    block = search.Block(batch, 0)
    term, weight = np.arange(4), np.array([5, 1, 2, 3])
    bounds = block.bounds(term, weight)
    scores, ids = block.visit(term, weight, bounds, 1, 300)
    place = {d: k for k, d in enumerate(block.docs.to_pylist())}
    assert all(s <= bounds[place[d] // search.CLUSTER] for s, d in zip(scores.tolist(), ids))
