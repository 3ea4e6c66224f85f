"""Rows that share a doc_id, with equal and other texts, and rows without one."""

import collections
import hashlib
import unicodedata

import pytest

from rasterloom.llm import common, idcoder, langid, lines, queries, rank_bpe, suffix
from tests.llm.test_documents import line_set

L = "A passage of more than fifty bytes that several rows have in common, word for word."
M = "Nothing here resembles the other one: zebras quietly vex jumping kiwi farmers at dawn."
ROWS = [
    (0, L), (1, L), (1, M), (1, L + "\n" + M), (2, M), (2, M), (2, "short"), (2, "Short "), (3, None), (3, ""), (3, "x" * 200), (4, "x" * 120), (None, L), (None, M), (None, None),
    (5, "only here: " + L.upper()), (5, "12 only here: " + L.upper()),
]


@pytest.fixture(scope="module")
def repeats(spark):
    return spark.createDataFrame([(*r, "kept") for r in ROWS], "doc_id long, text string, n_removed string").repartition(3)


def bag(rows):
    return collections.Counter((d, t) for d, t in rows)


def covered_rows(rows):
    """What each row keeps: bytes under a 50-byte string that starts in a row with a smaller doc_id go."""
    own = lambda t: {(t or "").encode()[k : k + 50] for k in range(len((t or "").encode()) - 49)}
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        seen = set().union(*(own(t) for d, t in rows if doc is not None and d is not None and d < doc))
        hit = set()
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                hit.update(range(k, k + 50))
        out.append((doc, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in hit)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [None, 0])
def test_suffix_dedup_of_repeated_ids(repeats, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(suffix, "HOT", hot)
    assert collections.Counter((r["doc_id"], r["kept_sha256"]) for r in suffix.suffix_report(repeats).collect()) == covered_rows(ROWS)


def test_the_rows_of_the_probe_keep_what_only_they_have(spark):
    docs = spark.createDataFrame([(0, L), (1, L), (1, M)], "doc_id long, text string")
    assert bag((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix.dedup_suffixes(docs).collect()) == bag([(0, L), (1, ""), (1, M)])
    assert bag((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect()) == bag([(0, L), (1, ""), (1, M)])


def test_line_dedup_of_repeated_ids(repeats):
    """Every group of like lines stays in one text; equal rows keep the same, rows without doc_id everything."""
    out = lines.dedup_lines(repeats).select("doc_id", "text").collect()
    assert len(out) == len(ROWS)
    kept = bag((r["doc_id"], r["text"]) for r in out)
    assert all(kept[None, t] == 1 for d, t in ROWS if d is None)
    left = collections.Counter(line.strip().lower() for (d, t), n in kept.items() if d is not None and t for line in set(t.split("\n")) if line.strip() for _ in range(n if (d, t) not in ((2, M), (2, "short")) else 1))
    groups = collections.defaultdict(list)
    for line in {x.strip().lower() for d, t in ROWS if d is not None and t for x in t.split("\n") if x.strip()}:
        key = next((g for g in groups if len(line_set(g) & line_set(line)) * 10 >= 8 * len(line_set(g) | line_set(line))), line)
        groups[key].append(line)
    assert all(sum(left[x] for x in own) == 1 for own in groups.values()), (left, groups)


def test_language_id_of_repeated_ids(repeats):
    rows = langid.identify(repeats.withColumn("lang", repeats.n_removed)).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows if r["doc_id"] is None} == {"kept", "und"}


def test_letters_are_those_of_category_l():
    told = [chr(c) for c in range(0x3000) if langid.has_letter(chr(c))]
    assert told == [chr(c) for c in range(0x3000) if unicodedata.category(chr(c))[0] == "L"]


def test_numbers_in_circles_are_no_language(spark):
    docs = spark.createDataFrame([(k, "plain words of a language", "en") for k in range(20)] + [(50, "½ ² ①", "en"), (51, "Ⅷ _ 7", None), (52, "½ é", None)], "doc_id long, text string, lang string")
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert told[50] == told[51] == ("und", 0.0) and told[52][0] == "en"


def test_ranks_of_repeated_rows(repeats):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = rank_bpe.rank_digests(repeats, path, public_tokenizers.PATTERN)
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in found.collect()) == collections.Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)


def test_id_files_of_repeated_ids(spark, repeats):
    """Rows without doc_id first, rows of one doc_id in the order of their texts' hashes; starts leave no gap."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = idcoder.id_report(repeats, path).collect()
    assert len(found) == len(ROWS)
    at, order = 0, sorted(found, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    sizes = collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in ROWS)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in found) == sizes
    again = idcoder.id_report(repeats.repartition(7), path).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    idcoder.write_ids(repeats, where := common.scratch_path(spark, "ids"), path)
    assert idcoder.read_ids(spark.read.parquet(where)).where("doc_id IS NULL").count() == 3
