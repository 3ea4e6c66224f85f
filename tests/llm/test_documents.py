"""Operators 2, 3, 4, 8, 10, and the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, components, jaccard, langid, lines, lm, queries, shingles, suffix
from tests.conftest import DATA

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().translate(bytes(shingles.LOWER))


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def of(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = sorted((self.of(i), self.of(j)))
        self.up[b] = a


def linked(sets, num, den):
    """Components of all pairs of sets with den * intersection >= num * union, by brute force over shared members."""
    groups, members, seen = Groups(sets), collections.defaultdict(list), set()
    for i, s in sets.items():
        for g in s:
            members[g].append(i)
    for ids in members.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        groups.join(i, j)
    return groups


# ---- operator 2


def test_op2(spark, duck):
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op2_langid(spark, DATA).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) >= 0.9 * len(out)


def test_langid_of_odd_documents(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in langid.identify(odd_docs).collect()}
    assert len(rows) == 17 and {k for k, r in rows.items() if r["lang_pred"] == "und"} == {0, 1, 2, 3}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] and rows[4]["score"] == rows[5]["score"]
    assert langid.identify(no_docs).count() == 0
    none = langid.predict(odd_docs, None)
    assert {r["lang_pred"] for r in none.select("lang_pred").collect()} == {"und"}
    assert "start" in none.columns and none.columns.count("score") == 1


def test_windows_cover_texts():
    data = np.arange(600, dtype=np.uint8)
    windows, owner = langid.cut_windows(data, np.array([0, 0, 256, 600]))
    assert owner.tolist() == [1, 2, 2] and np.array_equal(windows[1:].ravel()[:344], data[256:])


def test_tables_equal_the_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (12, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows, np.arange(12) % 2, ["a", "b"])
    x = net.embed[np.concatenate([windows, np.zeros((12, 3), np.uint8)], axis=1)]
    for k, (w, bank, bias) in enumerate(zip(langid.WIDTHS, net.banks, net.biases)):
        plain = sum(x[:, t : t + langid.WINDOW] @ bank[t] for t in range(w)).max(axis=1) + bias
        assert np.allclose(net.pooled(windows)[:, k * langid.FILTERS : (k + 1) * langid.FILTERS], np.maximum(plain, 0), atol=1e-4)


# ---- operator 3


def covered(texts):
    seen, out = set(), {}
    for doc, text in texts:
        raw = (text or "").encode()
        hit, own = np.zeros(len(raw) + 1, np.int64), set()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            if s in seen:
                hit[k : k + 50] = 1
            own.add(s)
        seen |= own
        kept = np.frombuffer(raw, np.uint8)[hit[: len(raw)] == 0].tobytes()
        out[doc] = (len(raw), int(hit.sum()), int((np.diff(np.concatenate([[0], hit])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def spans_of(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("hot", [None, 0])
def test_op3(spark, documents, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(suffix, "HOT", hot)
    assert spans_of(queries.op3_suffix_dedup(spark, DATA).collect()) == covered(documents)


def test_suffix_dedup_of_odd_documents(odd_docs, odd_texts, no_docs):
    assert spans_of(suffix.suffix_report(odd_docs).collect()) == covered(odd_texts)
    assert suffix.suffix_report(no_docs).count() == 0
    out = suffix.dedup_suffixes(odd_docs)
    assert out.columns.count("removed") == 1 and "start" in out.columns


@pytest.mark.parametrize(("n", "values"), [(0, 2), (1, 2), (300, 2), (2000, 3), (2000, 250), (200, 1)])
def test_suffix_arrays(n, values):
    text = np.random.default_rng(n).integers(0, values, n).astype(np.uint8)
    raw = text.tobytes()
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    shared = suffix.common_prefixes(text, order, 50, 7)
    for k in range(1, n):
        a, b = raw[order[k - 1] :][:50], raw[order[k] :][:50]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("shard", [1 << 22, 1500, 200])
def test_shards_merge(shard):
    rng = np.random.default_rng(2)
    base = [bytes(rng.integers(97, 101, 60).astype(np.uint8)) for _ in range(20)]
    contexts = [b[rng.integers(0, 6) :][: rng.integers(52, 60)] for b in base for _ in range(8)]
    ids = rng.permutation(len(contexts)).astype(np.int64)
    least = {}
    for c, i in zip(contexts, ids.tolist()):
        for k in range(len(c) - 49):
            least[c[k : k + 50]] = min(least.get(c[k : k + 50], i), i)
    want = [bytes(least[c[k : k + 50]] < i for k in range(len(c) - 49)) for c, i in zip(contexts, ids.tolist())]
    assert suffix.match_contexts(contexts, ids, shard) == [w if any(w) else None for w in want]


@pytest.mark.parametrize("hot", [4096, 30, 0])
def test_contexts_meet_once(spark, monkeypatch, hot):
    """Places of contexts get their ranges where they meet; only those of anchors of more than PLACES places are
    combined and joined back."""
    rng = np.random.default_rng(5)
    passages = [bytes(rng.integers(97, 123, 90).astype(np.uint8)).decode() for _ in range(4)]
    texts = [(0, ""), (1, None), (2, "x" * 49)]
    for k in range(3, 80):
        own = bytes(rng.integers(97, 123, 40).astype(np.uint8)).decode()
        p = passages[0 if k % 4 else int(rng.integers(1, 4))]
        at = int(rng.integers(0, 90))
        texts.append((k, own + (p[:at] + "é" + p[at + 1 :] if k % 3 else p) + own[::-1]))
    joined, stored = [], suffix.common.stored
    monkeypatch.setattr(suffix.common, "stored", lambda s, df, what, *a: (joined.append(what), stored(s, df, what, *a))[1])
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert spans_of(suffix.suffix_report(docs).collect()) == covered(texts)
    assert ("verdicts" in joined) == (hot < 4096)


def test_sorted_starts_and_cuts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, 3000).astype(np.uint8)
    text[1000:1400] = text[:400]
    at = np.flatnonzero(rng.integers(0, 3, 2900))
    order, new, _ = suffix.sorted_starts(text, at)
    strings = [text[a : a + 50].tobytes() for a in at[order].tolist()]
    assert strings == sorted(strings) and new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]
    data, offsets = np.arange(200, dtype=np.uint8), np.array([0, 60, 60, 130, 200])
    kept, removed = suffix._cut(data, offsets, np.array([0, 2, 3, 0, 0, 1]), np.array([10, 20, -1, 0, 5, -1]), np.array([11, 21, -1, 1, 11, -1]))
    assert removed.to_pylist() == [[{"start": 0, "stop": 60}], [], [{"start": 20, "stop": 70}], [{"start": 0, "stop": 70}]]
    assert [len(k) for k in kept.to_pylist()] == [0, 0, 20, 0] and kept[2].as_py() == bytes(range(60, 80))


# ---- operator 4

def line_set(line):
    raw = line.encode("utf-16-be")
    return frozenset(raw[k : k + 24] for k in range(0, max(len(raw) - 23, 1), 2))


def line_brute(texts):
    sets = {}
    for doc, text in texts:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if line := line.strip(" ").lower():
                sets[doc, k] = line_set(line)
    groups = linked(sets, 8, 10)
    out = {}
    for doc, text in texts:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (doc, k) not in sets or groups.of((doc, k)) == (doc, k)]
        out[doc] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def test_op4(spark, documents):
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.op4_line_dedup(spark, DATA).collect()} == line_brute(documents)


def test_line_dedup_of_odd_documents(odd_docs, odd_texts, no_docs):
    out = lines.line_report(odd_docs)
    assert {r["doc_id"]: r["kept_sha256"] for r in out.collect()} == line_brute(odd_texts)
    assert lines.line_report(no_docs).count() == 0
    whole = {r["doc_id"]: r for r in lines.dedup_lines(odd_docs).collect()}
    assert whole[0]["text"] is None and whole[0]["n_lines"] == 0 and whole[1]["text"] == "" and whole[5]["text"] == ""
    assert whole[4]["n_removed"] == 0 and whole[11]["n_removed"] == 1 and whole[4]["start"] == 7


def test_line_dedup_stays_in_the_engine(odd_docs):
    plan = lines.dedup_lines(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_of_one_bucket_all_meet(spark, monkeypatch):
    """Many groups of near copies in one frame, and a chain, all in one bucket."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    frame, rows = " ".join(word() for _ in range(10)), []
    for _ in range(40):
        own = [word() for _ in range(20)]
        rows += [f"{frame} {' '.join(own)}", f"{frame} {' '.join(own[:-1])} {word()}"]
    chain = [word() for _ in range(36)]
    rows += [" ".join(chain[k : k + 32]) for k in (2, 0, 4)]
    texts = list(enumerate("\n".join(rows[k::5]) for k in range(5)))
    signatures = lines.signatures
    monkeypatch.setattr(lines, "signatures", lambda docs: signatures(docs).withColumn("bands", F.array(F.lit(0).cast("long"))))
    for tile in (256, 4):
        monkeypatch.setattr(lines, "TILE", tile, raising=False)
        out = lines.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["kept_sha256"] for r in out} == line_brute(texts)
        assert sum(r["n_removed"] for r in out) == 42


@pytest.mark.parametrize(("groups", "size", "changed"), [(150, 3, 2), (60, 4, 9)])
def test_templated_lines(spark, groups, size, changed):
    """Lines from one template, in groups that each change some words of it: against all pairs."""
    rng = np.random.default_rng(groups + changed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    template, texts = [word() for _ in range(60)], []
    for _ in range(groups):
        own = list(template)
        for k in rng.choice(60, changed, replace=False):
            own[k] = word()
        for _ in range(size):
            line = list(own)
            line[rng.integers(60)] = word()
            texts.append((len(texts), " ".join(line)))
    out = lines.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = line_brute(texts)
    should = {d for d, t in texts if want[d] != hashlib.sha256(t.encode()).hexdigest()}
    gone = {r["doc_id"] for r in out if r["n_removed"]}
    assert len(gone & should) >= 0.99 * len(should) and gone <= should


def test_lines_that_share_a_passage(spark, monkeypatch):
    """Lines of one bucket that share about three fifths of their shingles: bitmaps keep those below 0.8 from leaving the tiles."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    template, rows = [word() for _ in range(60)], []
    for _ in range(30):
        own = list(template)
        for k in rng.choice(60, 3, replace=False):
            own[k] = word()
        rows.append(" ".join(own))
    texts, met = list(enumerate(rows)), []
    signatures, rest_pairs = lines.signatures, lines.rest_pairs

    def counted(*given):
        out = rest_pairs(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(lines, "signatures", lambda docs: signatures(docs).withColumn("bands", F.array(F.lit(0).cast("long"))))
    monkeypatch.setattr(lines, "rest_pairs", counted)
    out = lines.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in out} == line_brute(texts)
    assert met[0] <= 30


def test_near_copies_grow_together(spark, monkeypatch):
    """Near copies that their bucket's leaders left apart are linked by a pair a line; few are left to meet all others."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    rows = []
    for template in ([word() for _ in range(60)] for _ in range(5)):
        for _ in range(14):
            own = list(template)
            own[rng.integers(60)] = word()
            rows.append(" ".join(own))
    texts, met = list(enumerate(rows)), []
    signatures, rest_pairs = lines.signatures, lines.rest_pairs

    def counted(*given):
        out = rest_pairs(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(lines, "signatures", lambda docs: signatures(docs).withColumn("bands", F.array(F.lit(0).cast("long"))))
    monkeypatch.setattr(lines, "rest_pairs", counted)
    out = lines.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in out} == line_brute(texts)
    assert met[0] <= 160  # of 3 x 91 pairs within the three templates that never led


def test_lines_without_spaces(spark):
    """A character put in front changes one shingle only, whatever the script."""
    rng = np.random.default_rng(8)
    chinese = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 300))
    address = "https://example.org/" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 200))
    texts = [(1, chinese), (2, "新" + chinese), (3, address), (4, address.replace("https", "http")), (5, "Yes."), (6, "yes. "), (7, "No."), (8, "")]
    out = {r["doc_id"]: r["n_removed"] for r in lines.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0}


# ---- operator 8


def unigrams(texts):
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in texts}
    counts = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in tokens.items()}


def scores_of(rows):
    return {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows}


def test_op8(spark, documents):
    rows = queries.op8_lm_score(spark, DATA).collect()
    assert scores_of(rows) == unigrams(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0 for r in rows)
    sizes = {d: len((t or "").encode()) + 1 for d, t in documents}
    held = [r for r in rows if r["held_out"]]
    assert -sum(r["score"] for r in held) / math.log10(2) / sum(sizes[r["doc_id"]] for r in held) < 3.2  # bits a byte; 8 unlearned


def test_scores_of_odd_documents(odd_docs, odd_texts, no_docs):
    rows = lm.lm_report(odd_docs).collect()
    assert scores_of(rows) == unigrams(odd_texts)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert set(by) == {d for d, _ in odd_texts} and all(x < 0 for x in by.values())
    assert lm.lm_report(no_docs).count() == 0
    untrained = lm.score(odd_docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in untrained)


def plain_units(text):
    raw = bytes(text, "utf-8").translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return re.findall(rb"[^ \t-\r]*[ \t-\r]", raw) + [re.search(rb"[^ \t-\r]*\Z", raw).group() + b"\0"]


def plain_mixer(texts, train, tree, part):
    """Bits of each unit of one bucket's texts, by dictionaries of whole contexts and one decision at a time."""
    word_counts, slots = collections.Counter(), collections.defaultdict(lambda: [0, 0])

    def steps(text, seen=plain_units):
        before, past = b"", b""
        for unit in seen(text):
            rows = []
            for at, byte in enumerate(unit):
                symbol = 256 if at == len(unit) - 1 and byte == 0 else byte
                done = unit[:at]
                contexts = [done[-k:] for k in (1, 2, 3)] + [done, (past + done)[-6:], (before, done)]
                first = int(tree.first[symbol])
                for depth in range(int(tree.sizes[symbol])):
                    node, bit = int(tree.nodes[first + depth]), int(tree.bits[first + depth])
                    rows.append(([(k, c, node) for k, c in enumerate(contexts)], node, bit, min(depth, 3)))
            yield unit, rows
            before, past = unit, past + unit

    for text, learned in zip(texts, train):
        for unit, rows in steps(text) if learned else ():
            word_counts[unit] += 1
            for keys, _, bit, _ in rows:
                for key in keys:
                    slots[key][bit] += 1
    total = sum(word_counts.values())
    weights = [[lm.START_WEIGHT] * 6 for _ in range(lm.GATES)]
    cells, trust, out = {}, [0.5] * 3, []
    queue = [(u, rows, learned, k == 0, text) for text, learned in zip(texts, train) for k, (u, rows) in enumerate(steps(text))]
    known = 0
    tasks = []
    for unit, rows, learned, first, _ in queue:
        tasks.append((unit, rows, learned, 0 if first else 1 + (known > 0)))
        known = word_counts[unit] - learned
    while tasks:
        size, now = 0, []
        while tasks and (not now or size + len(tasks[0][0]) <= part):
            size += len(tasks[0][0])
            now.append(tasks.pop(0))
        grads, seen = collections.defaultdict(lambda: [0.0] * 6), collections.Counter()
        fresh, shares = collections.Counter(), collections.defaultdict(list)
        for unit, rows, learned, before in now:
            spelled = 0
            for keys, node, bit, depth in rows:
                x = []
                for key in keys:
                    z, o = slots.get(key, (0, 0))
                    z, o = z - (learned and not bit), o - (learned and bit)
                    x.append(math.log((o + lm.PRIOR) / (z + lm.PRIOR)) if z + o > 0 else 0.0)
                gate = depth * 8 + (x[3] != 0) + 2 * (x[4] != 0) + 4 * (x[5] != 0)
                dot = max(-12, min(12, sum(a * b for a, b in zip(weights[gate], x))))
                p = 1 / (1 + math.exp(-dot))
                column = int(min(max(round((dot + 8) / 0.5), 0), 32))
                centre = 1 / (1 + math.exp(8 - column * 0.5))
                a, b = cells.get((node, column), (0, 0))
                refined = (b + 16 * centre) / (a + b + 16)
                final = (p + refined) / 2
                spelled -= math.log2(max(final if bit else 1 - final, 1e-7))
                if learned:
                    fresh[node, column, bit] += 1
                    seen[gate] += 1
                    for k in range(6):
                        grads[gate][k] += (bit - p) * x[k]
            whole = max(word_counts[unit] - learned, 0) / max(total - 1, 1)
            said = (1 - trust[before]) * 2**-spelled + trust[before] * whole
            out.append(-math.log2(said))
            if learned:
                shares[before].append(trust[before] * whole / said)
        for gate, g in grads.items():
            for k in range(6):
                weights[gate][k] += lm.RATE * g[k] / math.sqrt(seen[gate])
        for (node, column, bit), n in fresh.items():
            pair = cells.setdefault((node, column), [0, 0])
            pair[bit] += n
        for before, xs in shares.items():
            rate = 1 - (1 - lm.UNIT_RATE) ** min(len(xs), 200)
            trust[before] = min(max(trust[before] + rate * (sum(xs) / len(xs) - trust[before]), 0.001), 0.999)
    return out


def test_the_mixer_is_a_plain_one(monkeypatch):
    monkeypatch.setattr(lm, "PART", 40)
    texts = ["The cat sat on the mat. The cat", "the dog sat\n\non the log", "", "a cat, a dog, a Cat sat", "été\x00 là the mat ", "the cat sat on the dog"]
    train = np.array([True, True, True, False, True, True])
    low, starts, hashes, per_text = lm.units(*common.flat_bytes(pa.array(texts)))
    raw = [low[a:z].tobytes() for a, z in zip(starts, starts[1:])]
    assert raw == [u for t in texts for u in plain_units(t)]
    learned = np.repeat(train, per_text)
    counts = collections.Counter(u for u, t in zip(raw, learned) if t)
    symbols = np.zeros(lm.SYMBOLS)
    symbols[:256] = np.bincount(np.concatenate([np.frombuffer(u, np.uint8) for u, t in zip(raw, learned) if t]), minlength=256)
    tree = lm.Tree(symbols)
    table = np.zeros(2 * lm.SLOTS, np.float32)
    units = pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()))], names=["unit", "n"])
    whole = pa.record_batch([pa.array([t for t, x in zip(texts, train) if x])], names=["text"])
    for sums in lm.add_chunks([*lm.count_within(tree)([units]), *lm.count_across(tree)([whole])]):
        part = lm._unpacked(sums.column(1)[0].as_py())
        at = sums.column(0)[0].as_py()
        table[at : at + len(part)] += part
    model = lm.Mixer(tree, lm.states(table), sum(counts.values()))
    found = model.bits(low, starts, hashes, per_text, train, np.array([counts[u] for u in raw]))
    np.testing.assert_allclose(found, plain_mixer(texts, train.tolist(), tree, 40), rtol=2e-4)


# ---- operator 10


def sets_of(texts):
    out = {}
    for d, t in texts:
        w = WORD.findall(lower(t))
        out[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def joined(texts):
    sets = sets_of(texts)
    groups = linked(sets, 80, 100)
    return {d: (len(s), groups.of(d)) for d, s in sets.items()}


def components_of(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_op10(spark, documents):
    assert components_of(queries.op10_jaccard_join(spark, DATA).collect()) == joined(documents)


def test_join_of_odd_documents(odd_docs, odd_texts, no_docs):
    assert components_of(jaccard.component_table(odd_docs).collect()) == joined(odd_texts)
    assert jaccard.component_table(no_docs).count() == 0


def test_join_of_chains_and_near_copies(spark, monkeypatch):
    """A large group of near copies, a chain, and many texts that share a passage; small tiles and a coarse sketch."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    base = list(rng.choice(words, 120))
    texts = []
    for k in range(40):
        own = list(base)
        for i in rng.integers(0, 120, 2):
            own[i] = f"edit{k}"
        texts.append(" ".join(own))
    chain = list(rng.choice(words, 100))
    for k in range(12):
        texts.append(" ".join(chain[4 * k :] + [f"tail{i}" for i in range(4 * k)]))
    passage = " ".join(rng.choice(words, 40))
    texts += [f"{passage} " + " ".join(f"u{k}x{i}" for i in range(int(rng.integers(5, 60)))) for k in range(30)]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)) + 1, texts)]
    assert components_of(jaccard.component_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == joined(sorted(rows))


def test_bit_count_bound_is_above_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        a, b = np.sort(shingles.mix64(a)), np.sort(shingles.mix64(b))
        bits = [jaccard.bitmap(a), jaccard.bitmap(b)]
        t = {"n": np.array([len(a), len(b)]), "bits": np.array(bits, object), "size": np.array([len(x) for x in bits])}
        _, _, spare = jaccard.bits_fit(t, np.array([0]), np.array([1]))
        enough = len(np.intersect1d(a, b)) - jaccard.needed(len(a), len(b))
        assert (len(spare) == 1 and spare[0] >= enough) if enough >= 0 else True


def test_levels_order_counts():
    counts = np.unique(np.concatenate([np.arange(300), 2 ** np.arange(8, 32, dtype=np.int64)]))
    levels = jaccard.level(counts).astype(int)
    assert (np.diff(levels) >= 0).all() and levels[-1] > levels[300] and len(set(levels[:9])) == 9


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000)]
    groups = Groups({x for p in pairs for x in p})
    for a, b in pairs:
        groups.join(a, b)
    frame = spark.createDataFrame([*pairs, pairs[0], (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
    assert found == {x: groups.of(x) for p in pairs for x in p if p[0] != p[1]}
    assert components.connected_components(frame.limit(0)).count() == 0


# ---- the pipeline


def test_pipeline_stages(spark, documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from rasterloom.llm import common
    from tests.llm.test_tokens_and_media import check_packing

    docs = common.table(spark, DATA, "documents")
    columns = docs.columns
    texts = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(spark, stage(spark, docs, DATA), "stage")
        if name == "best-fit packing":
            check_packing(docs.collect(), texts)
            break
        assert docs.columns == columns
        now = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.select("doc_id", "text", "n_chars").collect())
        assert all(len(t) == n for _, t, n in now)
        now = [(d, t) for d, t, _ in now]
        if name == "language ID":
            assert {d for d, t in texts if re.search(r"[^\W\d_]", t or "")} - {d for d, _ in now} == set()
        elif name == "line dedup":
            kept = line_brute(texts)
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in now} == {d: kept[d] for d, _ in now}
        elif name == "n-gram Jaccard join":
            assert now == [(d, t) for d, t in texts if joined(texts)[d][1] == d]
        else:
            left = covered(texts)
            assert all(left[d][3] == hashlib.sha256(t.encode()).hexdigest() for d, t in now if "�" not in t)
            assert {d for d, t in texts} - {d for d, _ in now} == {d for d, (n, gone, _, _) in left.items() if n and n == gone}
        texts = now


def test_pipeline_of_odd_documents(spark, odd_docs, no_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from rasterloom.llm import common

    for docs, some in ((odd_docs, True), (no_docs, False)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(spark, stage(spark, docs, DATA), "stage")
        assert (docs.count() > 0) == some


def test_full_slots_keep_their_ratio():
    """Counts far beyond LEVELS: the log odds are those of the counts, not 0."""
    pairs = [(1_000_000, 100_000), (50, 7_000_000), (300_000, 300_000), (2, 3), (40_000, 900), (32_768, 16_384)]
    state = lm.states(np.array(pairs, np.float32).ravel())
    odds = lm.odds_tables()[: 1 << 16][state]
    for (zeros, ones), x in zip(pairs, odds.tolist()):
        assert abs(x - math.log((ones + lm.PRIOR) / (zeros + lm.PRIOR))) < 0.06 or zeros == 50  # a side that vanishes beside the other
    assert odds[1] > 10
    small = np.random.default_rng(1).integers(0, 128, 400).astype(np.float32)
    assert np.array_equal(lm.states(small), small[0::2].astype(np.uint16) << 8 | small[1::2].astype(np.uint16))


def test_hot_keys_of_a_join_are_few(spark):
    """However many rows a key has, fewer than HOT_SHARE keys are broadcast; all rows come back."""
    facts = spark.range(5000).selectExpr("id AS k", "IF(id < 5, 100000L, 3L) AS n", "id * 2 AS fact")
    facts.write.parquet(path := common.scratch_path(spark, "facts"))
    facts = spark.read.parquet(path)
    rows = spark.range(20000).selectExpr("id % 4000 AS k", "id AS row")
    out = common.spread_join(rows, facts, ["k"], "n")
    assert out.columns == ["k", "row", "fact"] and out.count() == 20000 and out.where("fact <> 2 * k").count() == 0
    total = facts.agg(F.sum("n")).first()[0]
    assert facts.where(F.col("n") > total // common.HOT_SHARE).count() < common.HOT_SHARE
