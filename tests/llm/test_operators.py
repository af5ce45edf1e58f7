"""Operators on training data against brute force, and the cases that every one of them must bear."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accesswatch.llm import decontaminate, html_text, language, line_dedup, near_dups, packing, quality_classifier
from accesswatch.llm.components import components
from accesswatch.llm.line_frequency import judge_documents
from accesswatch.llm.queries import QUERIES, SQL, held
from accesswatch.llm.token_rollups import Rollup, counted, deleted, inserted, revised
from accesswatch.llm.tokens import Encoder, token_count
from accesswatch.llm.url_filter import Trie, filter_urls

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that operators use inside, as further columns of the input.
CLASH = ["row", "_row", "digest", "part", "host", "kept", "n_words", "words", "lines", "score", "doc", "label", "key", "block"]

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def odd_texts():
    long = prose(30_000, 1)
    return [
        None, "", "\n", " \t ", "x", "é ü 中文", "a\r\nb\x0bc\x0c", long, long, "y" * 50_000, "\n" * 3000, "tie tie tie tie tie tie",
        "<p>", "&amp;&", "1 2 3", prose(60, 2), prose(60, 2), prose(60, 3) + "\n" + prose(60, 2),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, nulls in every column, and columns with names used inside."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(odd_texts())]
    rows += [rows[15], (None, prose(60, 2), None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


# --- quality rules -------------------------------------------------------------------


def brute_statistics(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    hit = {i + k for i in range(len(own) - 4) if grams[tuple(own[i : i + 5])] > 1 for k in range(5)}
    return (
        len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
        len(hit),
    )


def test_statistics_of_odd_texts(odd):
    found = judge_documents(odd.select("doc_id", "text", "source"), ["doc_id", "text"]).collect()
    assert len(found) == odd.count()
    for r in found:
        own = brute_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])


def brute_rules(rows):
    """Kept documents and their texts: base rules, then lines of at least 5 texts and 5 % of the host's; rows are (id, text, host)."""
    texts, holders, out = defaultdict(set), defaultdict(set), {}
    for _, t, h in rows:
        texts[h or ""].add(t or "")
    for h, own in texts.items():
        for t in own:
            for line in t.split("\n"):
                if words(line):
                    holders[h, tuple(words(line))].add(t)
    often = {k for k, own in holders.items() if len(own) >= 5 and 100 * len(own) > 5 * len(texts[k[0]])}
    for d, t, h in rows:
        n, _, _, _, repeated = brute_statistics(t)
        gone = [tuple(words(line)) for line in (t or "").split("\n") if (h or "", tuple(words(line))) in often]
        left = n - sum(map(len, gone))
        depleted = bool(gone) and (left < 10 or 100 * left < 30 * n)
        if n >= 10 and 100 * repeated <= 20 * n and not depleted:
            out[d] = "\n".join(x for x in (t or "").split("\n") if (h or "", tuple(words(x))) not in often)
    return out, len(often)


def test_rules_against_brute_force(spark, sf_small):
    """On the given table lines are removed, and of texts made of such lines too little is left."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source")
    hosts = docs.withColumn("source", F.when(F.length("source") > 4, "one").otherwise("other"))
    lines = F.split("text", "\n")
    menu = hosts.select((F.col("doc_id") + 10_000).alias("doc_id"), F.array_join(F.slice(lines, 1, 2), "\n").alias("text"), "source")
    both = hosts.unionByName(menu.where("length(text) < 400"))
    want, often = brute_rules([tuple(r) for r in both.collect()])
    found = judge_documents(both, ["doc_id"]).where("kept").collect()
    assert {r.doc_id: r.left_text for r in found} == want and often > 0
    assert len(want) < both.count() and any(r.left_text == "" or r.n_left_words < r.n_words for r in found)


def test_frequent_lines_deplete_documents(spark):
    menu = "home about contact imprint and more of the same"
    rows = [(i, f"{menu}\n{prose(4, i)}", "en", "h") for i in range(30)] + [(99, f"{menu}\n{prose(80, 99)}", "en", "h")]
    rows += [(100 + i, prose(40, 5), "en", "copies") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in judge_documents(docs, ["doc_id"], min_docs=10).collect()}
    assert [found[i].kept for i in (0, 29, 99, 100, 129)] == [False, False, True, True, True]
    assert found[0].n_left_words == 4 and not found[0].base_failed


@pytest.fixture(scope="module")
def menus(spark):
    """With the production limits: on host h 60 of 200 texts have a short menu line, on host few 3 of 200, on small 4 of 6."""
    menu = "Home  About Contact"
    rows = [(i, f"{menu}\n{prose(9, i)}", "en", "h", 0) for i in range(30)]
    rows += [(i, f"\n Home About\tContact \n\n{prose(40, i)}\n{menu}\n{menu}\n", "en", "h", 0) for i in range(30, 60)]
    rows += [(i, f"{prose(40, i)}\nHome {i}\n", "en", "h", 0) for i in range(60, 200)]
    rows += [(i, f"{menu}\n{prose(40, i)}", "en", "few", 0) for i in range(200, 203)]
    rows += [(i, prose(40, i), "en", "few", 0) for i in range(203, 400)]
    rows += [(i, f"{menu}\n{prose(40, i)}", "en", "small", 0) for i in range(400, 404)]
    rows += [(i, prose(40, i), "en", "small", 0) for i in range(404, 406)]
    return spark.createDataFrame(rows, DOCS)


def test_stage_removes_frequent_host_lines(spark, menus, sf_small):
    found = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, menus, sf_small).collect()}
    want = {r.doc_id: r.text for r in menus.collect() if r.doc_id >= 30}
    want |= {i: f"\n\n{prose(40, i)}\n" for i in range(30, 60)}
    assert {i: r.text for i, r in found.items()} == want
    assert all(r.n_chars == len(r.text) for r in found.values())


# --- line deduplication --------------------------------------------------------------


def brute_lines(rows, min_chars, min_docs):
    holders = defaultdict(set)
    keyed = lambda x: x.encode().strip().lower().decode()
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders[keyed(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [
            d is not None and len(keyed(x)) >= min_chars and len(holders[keyed(x)]) >= min_docs and d != max(holders[keyed(x)])
            for x in lines
        ]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_lines_against_brute_force(spark, partitions):
    r = random.Random(3)
    common = [" " * (i % 3) + prose(12, i).title() + "É" * (i % 2) for i in range(12)]
    rows = [(i, "\n".join(r.choice(common) if r.random() < 0.6 else prose(9, i * 50 + k) for k in range(r.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = line_dedup.deduplicated(docs, 40, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([(x.doc_id, x.lines.n_lines, x.lines.n_dropped, x.text) for x in found], key=str) == brute_lines(rows, 40, 5)


def test_lines_of_odd_texts(odd):
    docs = odd.select("doc_id", "text")
    found = line_dedup.deduplicated(docs, 1, 2).collect()
    mine = sorted([(x.doc_id, x.lines.n_lines, x.lines.n_dropped, x.text or "") for x in found], key=str)
    assert mine == brute_lines(texts_of(docs), 1, 2)


def test_a_key_over_several_tasks():
    edges = [(0, 0, 1, 1, 3, 9, 7), (0, 1, 2, 2, 2, 50, 40), (1, 0, 2, 2, 2, 40, 30), (2, 0, 2, 2, 1, 30, 30), (2, 1, 5, 5, 1, 1, 1)]
    assert line_dedup.spanning(edges) == {(2, 2): (3, 50)}


def test_bitmaps_are_compressed_keeps(spark):
    line = prose(12, 1)
    docs = spark.createDataFrame([(i, f"a{i}\n{line}\nb") for i in range(5)], "doc_id bigint, text string")
    for r in line_dedup.keep_bitmaps(docs).collect():
        assert (r.n_lines, r.n_dropped) == (3, 1) and r.doc < 4
        assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=3).tolist() == [1, 0, 1]


# --- near-duplicates -----------------------------------------------------------------


def brute_components(rows, pct=85):
    sets = {}
    for d, t in rows:
        own = words(t, True)
        s = frozenset(zip(*[own[k:] for k in range(5)])) if len(own) >= 5 else frozenset([tuple(own)]) if own else frozenset()
        sets[d] = s
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(r.randint(6, 160), 1000 + g).split()
        for _ in range(r.randint(1, 12)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(WORDS)
            rows.append(" ".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("most", [2, 1024])
def test_components_against_brute_force(spark, copies, most):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs, most=most).collect()}
    assert found == brute_components(copies)


def test_near_duplicates_of_odd_texts(odd):
    found = near_dups.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(found) == odd.count()
    want = brute_components([x for x in texts_of(odd) if x[0] is not None])
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_pairs_below_the_distance_share_a_key():
    shape = near_dups.Signature()
    draw = np.random.default_rng(2)
    a = draw.integers(0, 256, (300, shape.size), np.uint8)
    b = a.copy()
    bound = shape.chunks * (shape.errors + 1) - 1
    for row in b:
        at = draw.choice(shape.size, bound, replace=False)
        row[at] ^= draw.integers(1, 256, bound).astype(np.uint8)
    distance, first = shape.first_shared(a, b)
    assert (distance == bound).all() and (first >= 0).all()
    ka, kb = shape.keys(a), shape.keys(b)
    assert [int(np.flatnonzero(x == y)[0]) for x, y in zip(ka, kb)] == first.tolist()


def test_pairs_that_share_a_key_are_confirmed_at_any_distance():
    shape = near_dups.Signature()
    a = np.zeros(shape.size, np.uint8)
    b = a.copy()
    b[shape.width + 1 :] = 1
    columns = {"group": ["g"] * 2, "doc": [1, 2], "n_shingles": [50, 50], "number": [0, 0], "block": [0, 0], "label": [1, 2]}
    batch = pa.RecordBatch.from_pydict(columns | {"signature": [a.tobytes(), b.tobytes()]})
    found = pa.Table.from_batches(near_dups._candidates(shape, 85, True)(iter([batch]))).to_pydict()
    assert found == {"group": ["g", "g"], "doc": [1, 2], "partners": [[2], []]}


def test_sketches_leave_out_no_link():
    draw, far = np.random.default_rng(8), 0
    for i in range(600):
        n = int(draw.integers(1, 40)) if i % 2 else int(draw.integers(100, 3000))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        gone = int(draw.integers(0, max(1, n // 5) + 1))
        y = np.unique(np.concatenate((x[gone:], draw.integers(0, 2**63, int(draw.integers(0, gone + 1))).astype(np.uint64))))
        a, b = (np.frombuffer(near_dups.parity(s), np.uint64)[None] for s in (x, y))
        both = len(np.intersect1d(x, y))
        linked = 100 * both >= 85 * (len(x) + len(y) - both)
        out = bool(near_dups.too_far(a, b, np.array([len(x) + len(y)]), 85)[0])
        assert not (linked and out)
        far += out
    assert far > 100


def test_texts_with_a_passage_in_common_are_not_sent_to_be_confirmed():
    """Two thirds of each text are one passage; all have one signature, so that all share a key. Two are linked."""
    shape, passage = near_dups.Signature(), prose(100, 40)
    texts = [passage + " " + prose(50, 50 + i) for i in range(40)]
    texts.append(texts[7] + " end")
    sets = [near_dups.shingles(t, 5) for t in texts]
    n = len(texts)
    columns = {"group": ["g"] * n, "doc": range(n), "n_shingles": [len(s) for s in sets], "number": [0] * n, "block": [0] * n}
    columns |= {"label": range(n), "signature": [bytes(shape.size)] * n, "parity": [near_dups.parity(s) for s in sets]}
    found = pa.Table.from_batches(near_dups._candidates(shape, 85, True)(iter([pa.RecordBatch.from_pydict(columns)]))).to_pydict()
    assert found == {"group": ["g", "g"], "doc": [7, 40], "partners": [[40], []]}


def test_signatures_estimate_similarity():
    shape, differ = near_dups.Signature(), []
    for i in range(200):
        x = np.unique(np.random.default_rng(i).integers(0, 2**63, 400).astype(np.uint64))
        y = np.unique(np.concatenate((x[33:], np.random.default_rng(i + 999).integers(0, 2**63, 33).astype(np.uint64))))
        a, b = (np.frombuffer(shape.of(s), np.uint8) for s in (x, y))
        differ.append((a != b).mean())
    assert abs(np.mean(differ) - (1 - 367 / 433)) < 0.01


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.doc: r.component for r in found} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# --- decontamination -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=13):
    lower = lambda t: WORD.findall((t or "").encode().lower().decode())
    own, hit, found = lower(text), set(), set()
    for item, t in items:
        w = lower(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [300, 10_000_000])
def test_contamination_against_brute_force(spark, odd, max_bytes):
    items = [(1, prose(40, 51)), (2, prose(13, 52)), (3, "Tie-tie"), (10, "中文"), (4, None), (5, "..."), (6, prose(20, 51)), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    more = [(200, prose(50, 1) + " " + " ".join(prose(40, 51).split()[5:30]) + " " + prose(30, 9)), (201, prose(40, 51).upper().replace(" ", "; "))]
    docs = odd.select("doc_id", "text").where("length(text) < 20000 OR text IS NULL").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string")
    )
    found = decontaminate.find_contamination(docs, benchmark, ["doc_id", "text"], max_bytes=max_bytes).collect()
    assert len(found) == docs.count()
    for r in found:
        n, hit, own = brute_hits(r.text, [x for x in items if x[0] is not None])
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (n, hit, own, hit > 0 and 20 * hit >= n)
        assert sum(s.stop - s.start for s in r.spans) == hit


def test_stretches_overlap():
    text = prose(5000, 4)
    matcher = decontaminate.Matcher([("i", decontaminate.words_of(prose(5000, 4))[100:140])], 13)
    whole = matcher.search(text)
    parts = list(decontaminate.stretches(text, 12, 500))
    assert len(parts) > 10 and parts[-1][0] + len(parts[-1][1]) == 5000
    found = {(b + s, b + e) for b, w in parts for s, e, _ in matcher.find(w)}
    assert decontaminate.joined(found) == whole[1] == [(100, 140)]


# --- tokens --------------------------------------------------------------------------


@pytest.mark.parametrize("vocabulary", [JSON, MULTI])
def test_ids_equal_the_uncut_text(vocabulary):
    texts = [t or "" for t in odd_texts()] + [
        "a  b", " a", "a ", "a \n b", "don't  'tis 's", "x y z", "a  b", "12 34,5 a1b2", "<|endoftext|> x<|endoftext|>", "\ta\t b",
    ]
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(vocabulary)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    else:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = [own.encode_ordinary(t) for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocabulary, public_tokenizers.PATTERN, most=5).encode(texts)]
    assert got == want


def test_packing_is_a_round_trip(odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    pieces = [r.asDict() for r in packing.pack(odd, JSON).collect()]
    want = Counter(
        (d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in texts_of(odd)
    )
    by_sequence = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_sequence[p["sequence_id"]].append(p)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(p["length"] for p in pieces)
    # A document's pieces lie end to end; equal documents are told apart by using each piece once.
    held = defaultdict(lambda: defaultdict(list))
    for p in pieces:
        held[p["doc_id"], p["doc_tokens"]][p["start"]].append(p)
    got = Counter()
    for (doc, total), starts in held.items():
        while starts.get(0):
            at, ids = 0, b""
            while at < total:
                p = starts[at].pop()
                ids, at = ids + p["ids"], at + p["length"]
            got[doc, ids] += 1
        assert not any(starts.values())
    assert got == want


def test_classes_hold_a_fixed_number():
    packer = packing.Packer(2048, 64, 0)
    for doc in range(300):
        packer.add(doc, bytes(4 * (100 + doc % 5)))
    full = Counter(row[5] for row in packer.out)
    sizes = {row[5]: 2048 // row[2] for row in packer.out}
    assert all(full[s] == sizes[s] for s in full)
    assert packing.cut_lengths(5000, 2048, 64) == [2048, 2048, 512, 256, 128, 8] and packing.powers(13) == [8, 4, 1]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = [None, "", "a b", prose(300, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.n for r in df.select("i", token_count(F.col("t"), JSON).alias("n")).collect()}
    assert found == {i: None if t is None else len(plain.encode(t).ids) for i, t in enumerate(texts)}


def test_rollup_batches(spark, tmp_path):
    def counts(*rows):
        return spark.createDataFrame(rows, "source string, lang string, version string, tokens bigint, chars bigint")

    a, b, c = ("s", "en", "v1", 10, 40), ("s", None, "v1", 7, 20), (None, "de", "v2", None, None)
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", inserted(counts(a, a, b, c)))
    assert not rollup.commit("one", inserted(counts(a)))
    rows = lambda: {tuple(r) for r in rollup.totals().collect()}
    assert rows() == {("s", "en", "v1", 2, 20, 80), ("s", None, "v1", 1, 7, 20), (None, "de", "v2", 1, 0, 0)}
    rollup.commit("two", revised(counts(a), counts(("s", "fr", "v1", 11, 41))).unionByName(deleted(counts(b))))
    want = {("s", "en", "v1", 1, 10, 40), ("s", "fr", "v1", 1, 11, 41), (None, "de", "v2", 1, 0, 0)}
    assert rows() == want
    rollup.compact("c1")
    assert rows() == want
    # Rows of a batch that was never committed do not count, and a repeat replaces them.
    inserted(counts(a)).groupBy("source", "lang", "version").agg(
        *[F.lit(5).cast("long").alias(x) for x in ("n_docs", "n_tokens", "n_chars")]
    ).write.parquet(str(tmp_path / "r" / "batches" / "three"))
    assert rows() == want
    rollup.commit("three", inserted(counts(c).where("false")))
    assert rows() == want and rollup.committed() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        rollup.commit("../x", inserted(counts(a)))


def plain_encoders():
    """Both vocabularies over uncut texts."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(JSON)
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    multi = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {"byte_bpe_50k": lambda t: own.encode(t, add_special_tokens=False).ids, "byte_bpe_multi_50k": multi.encode_ordinary}


def test_counted_texts(spark, odd, none):
    """Both vocabularies, whole texts and texts without repeated lines, with columns of any name passing through."""
    plain = list(plain_encoders().values())
    rows = counted(odd.withColumn("_row", F.lit(1)), [JSON, MULTI], public_tokenizers.PATTERN).drop("text")
    assert {"row", "_row", "digest", "words"} <= set(rows.columns)
    found = Counter((r.doc_id, tuple(r.tokens), r.new_chars, r.new_tokens and tuple(r.new_tokens)) for r in rows.collect())
    want = Counter()
    for i, text in texts_of(odd):
        text = text or ""
        once = "\n".join(dict.fromkeys(text.split("\n")))
        new = (len(once), tuple(len(e(once)) for e in plain)) if once != text else (None, None)
        want[i, tuple(len(e(text)) for e in plain), *new] += 1
    assert found == want
    assert counted(none, [JSON], None).count() == 0


def test_small_memory_counts_the_same(monkeypatch):
    from accesswatch.llm.token_rollups import TokenCounter

    plain, counter = plain_encoders()["byte_bpe_50k"], TokenCounter([JSON], None, most=50)
    for seed in range(20):
        text = prose(30, seed) + ", x!!\n" + prose(5, seed)
        cut = counter.cut(text)
        counter.learn([cut])
        assert counter.count(cut) == [len(plain(text))]


def test_compaction_and_writers_at_once(spark, tmp_path, monkeypatch):
    """A batch that comes between the two looks of a compaction, and two writers of one batch, count once each."""
    counts = spark.createDataFrame([("s", "en", "v", 10, 40)], "source string, lang string, version string, tokens bigint, chars bigint")
    rollup, other = (Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    rollup.commit("one", inserted(counts))
    look, raced = rollup._fresh, []

    def late(folder):
        fresh = look(folder)
        if not raced:
            raced.append(other.commit("two", inserted(counts)))
        return fresh

    monkeypatch.setattr(rollup, "_fresh", late)
    assert rollup.compact() and raced == [True]
    monkeypatch.undo()
    rows = lambda: [tuple(r) for r in rollup.totals().collect()]
    assert rows() == [("s", "en", "v", 2, 20, 80)] and rollup.committed() == ["one", "two"]
    # Two writers that both found no marker: the first keeps its rows, the other adds none.
    monkeypatch.setattr(Rollup, "has", lambda self, batch: False)
    assert rollup.commit("three", inserted(counts)) and not other.commit("three", inserted(counts).unionByName(inserted(counts)))
    assert rows() == [("s", "en", "v", 3, 30, 120)]
    monkeypatch.undo()
    # Two compactions from one snapshot: the second changes nothing; covered batches stay refused without their markers.
    number = rollup._snapshot()
    assert rollup.compact()
    monkeypatch.setattr(other, "_snapshot", lambda: number)
    assert not other.compact()
    monkeypatch.undo()
    assert rows() == [("s", "en", "v", 3, 30, 120)] and not rollup.commit("one", inserted(counts))
    assert rollup._names("commits") == [] and rollup.committed() == ["one", "three", "two"]
    # A marker of a covered batch, left by a writer that was late, counts for nothing.
    inserted(counts).write.parquet(str(tmp_path / "late"))
    rollup._mark("commits", "one", "late")
    assert rows() == [("s", "en", "v", 3, 30, 120)]


def test_rollup_query_against_brute_force(spark, sf_small):
    want = defaultdict(lambda: [0, 0, 0])
    for version, plain in plain_encoders().items():
        seen = set()
        for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect():
            if r.text not in seen:
                seen.add(r.text)
                once = "\n".join(dict.fromkeys(r.text.split("\n")))
                own = want[r.source, r.lang, version]
                for i, n in enumerate((1, len(plain(once)), len(once))):
                    own[i] += n
    found = QUERIES["op4_token_rollups"](spark, sf_small).collect()
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens, r.n_chars] for r in found} == dict(want)


# --- urls ----------------------------------------------------------------------------


def test_urls_and_rules(spark):
    urls = [
        None, "", "x", "http://", "HTTP://A.Example.NET:80/en/x?y#z", "http://example.net/en", "http://b.net/", "http://b.net",
        "://org/fr/a", "http://notnet/", "http://a.org?x=/fr/", "http://x.org/fr/#/de/", "http://a.b/deep/er", "http://a.b/de",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").withColumn("host", F.lit("own"))
    own = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("a.b", "/de", "block"), ("a.b", "/deep/", "allow"), (None, "/", "block")]
    rules = spark.createDataFrame(own, "host string, path string, verdict string")
    for most in (100, 1):
        found = {r.page_id: tuple(r.judged) for r in filter_urls(pages, rules, max_rules=most).collect()}
        assert found[0] == found[1] == found[2] == found[3] == ("", "", None, "allow")
        assert found[4] == ("a.example.net:80", "/en/x", None, "allow")
        assert found[5] == ("example.net", "/en", "net/", "block") and found[6][2:] == ("net/", "block")
        assert found[7] == ("b.net", "", None, "allow") and found[8][2:] == ("org/fr/", "allow")
        assert found[9][2] is None and found[10][1:3] == ("", None) and found[11][1:] == ("/fr/", "org/fr/", "allow")
        assert found[12][2] == "a.b/deep/" and found[13][2:] == ("a.b/de", "block")


def test_trie_against_brute_force():
    r = random.Random(8)
    hosts = ["a", "b.a", "c.b.a", "x", ""]
    paths = ["", "/", "/p/", "/p/q", "/p/q/", "/pq"]
    rules = {(r.choice(hosts), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(20)}
    trie = Trie((h, p, v) for (h, p), v in rules.items())
    for _ in range(2000):
        host = ".".join(r.choices("abcx", k=r.randint(1, 4)))
        path = "/".join(r.choices(["", "p", "q", "pq"], k=r.randint(1, 4)))
        fits = [(len(h), len(p), h + p, v) for (h, p), v in rules.items() if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        found = trie.find(host, path)
        assert (found and found[:2]) == (best and best[2:])


# --- html ----------------------------------------------------------------------------


SENTENCE = "Words of the article follow each other here and there, long enough to be its text."


@pytest.mark.parametrize("part, text", [
    ("<section id='search-algorithms'><p>Found by search.</p></section>", "Found by search."),
    ("<h2 id='related-work'>Related work</h2>", "Related work"),
    ("<p data-id='share' title='x class=ad'>Shared twice.</p>", "Shared twice."),
    ("<p>Press <button>Start</button>, tick <label>this</label> and see <math>x</math>.</p>", "Press Start, tick this and see x."),
    ("<div class=x/><p>After it.</p></div>", "After it."),
    ("<div class='comment-free text'>Kept.</div>", "Kept."),
    ("<div class='story ad'>Buy now</div><div role=search>Find</div><button>Go</button><form><label>Name</label></form>", ""),
])
def test_parts_of_an_article(part, text):
    """Names that only hold a listed word are text in an article; whole class names and roles are not."""
    page = f"<body><nav>menu menu</nav><article><p>{SENTENCE}</p>{part}<p>{SENTENCE}</p></article><div id=comments-list>no no</div></body>"
    want = "\n".join(x for x in (SENTENCE, text, SENTENCE) if x)
    assert html_text.main_text(page, html_text.Weights()) == want


def test_pages_without_an_article_element(spark):
    """The run alone decides: dense paragraphs between lists of links."""
    r, rows, want = random.Random(3), [], {}
    links = "".join(f"<div><span><a href='/{i}'>x{i}</a></span></div>" for i in range(12))
    for i in range(30):
        paragraphs = [" ".join(r.choices(WORDS, k=r.randint(30, 60))) for _ in range(r.randint(2, 5))]
        body = "".join(f"<p>{p[:20]}<b>{p[20:30]}</b>{p[30:]}</p>" for p in paragraphs)
        rows.append((i, f"<html><body><div class=sidebar>{'old news ' * 40}</div>{links}<div>{body}</div>{links}</body></html>"))
        want[i] = "\n".join(paragraphs)
    labelled = [(100 + i, f"<body>{links}<article><p>{prose(50, i)}</p></article>{links}</body>") for i in range(5)]
    pages = spark.createDataFrame(rows + labelled, "page_id int, html string")
    weights = html_text.fit_weights(pages)
    found = {x.page_id: x.text for x in html_text.extract(pages, weights, ["page_id"]).collect()}
    assert {i: found[i] for i in want} == want
    empty = pages.where("false")
    assert html_text.extract(empty, html_text.fit_weights(empty), ["page_id"]).count() == 0


def test_pages(spark):
    body = "<article class='post'><header><h1>A &amp; B</h1></header><p>One  two\n three<br><p>Four <b>fi</b>ve &copy;&#33;</p>" \
        "<aside>no</aside><div class=\"ad-box\">buy</div><ul><li>x<li>y</ul><section id=comments>nice</section></article>"
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body class=menu-open>" \
        f"<nav><ul><li>home<li>{'menu ' * 50}</ul></nav><!-- <p>no</p> --><form>q</form>{body}<footer>f</footer></body></html>"
    want = "A & B\nOne two three\nFour fi ve ©!\nx\ny".replace("fi ve", "five")
    cases = [
        (page, want), (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a</p><p", "a"), ("<script>x", ""),
        ("<nav>never closed <p>m<article>text here</article>", "text here"), ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"),
        ("a &lt;b&gt; c &am", "a <b> c &am"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id int, html string").withColumn("text", F.lit("own"))
    weights = html_text.fit_weights(df)
    found = {r.page_id: r.text for r in html_text.extract(df, weights, ["page_id"]).collect()}
    assert found == {i: t for i, (_, t) in enumerate(cases)}


def test_best_run_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)] + [0])
        start, stop = html_text.best_run(scores)
        assert sum(scores[start:stop]) == best


def test_weights_follow_labelled_pages():
    page = "<body><div><span>a b</span></div><article><p>" + "w " * 50 + "</p><p>more</p></article><div>c</div></body>"
    weights = html_text.weights_of(html_text.count_parts(page))
    assert weights.word > 0.5 and weights.tags["p"] > weights.tags["div"] and max(weights.tags.values()) < 0


# --- language ------------------------------------------------------------------------


def brute_probability(pieces, p, word):
    numbers = {x: i for i, x in enumerate(pieces.pieces)}

    def rest(i):
        if i == len(word):
            return 1.0
        return sum(p[numbers[word[i:j]], 0] * rest(j) for j in range(i + 1, len(word) + 1) if word[i:j] in numbers)

    return rest(0)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(MULTI)
    assert (pieces.find(pieces.hashes) == np.arange(len(pieces.pieces))).all()
    p = np.random.default_rng(1).random((len(pieces.pieces), 1))
    p /= p.sum()
    own = [b" the", b" of", b"x", " éa".encode(), b" tion"]
    got = language.forward(pieces, p, own)[:, 0]
    assert np.allclose(got, [np.log(brute_probability(pieces, p, w)) for w in own])
    uses = language.expected(pieces, p, own, np.ones((len(own), 1)))
    spelled = sum(len(x) * uses[i, 0] for i, x in enumerate(pieces.pieces))
    assert np.isclose(spelled, sum(map(len, own)))


def test_languages_held_out(spark, sf_small, odd, none):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    found = QUERIES["op7_unigram_language"](spark, sf_small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 30 and sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    model = language.fit_language(docs, MULTI, sample=50)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model, ["doc_id"]).collect()}
    assert rows[0] == rows[1] == rows[2] == rows[14] == ("und", 0.0) and rows[7][0] in model.languages
    nothing = language.fit_language(none, MULTI)
    assert {r.lang_pred for r in language.identify(odd, nothing, ["doc_id"]).collect()} == {"und"}


# --- quality -------------------------------------------------------------------------


def test_quality_held_out(spark, sf_small):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    rows = QUERIES["op1_compression_quality"](spark, sf_small).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted for r in good) >= 0.8 * len(good)


def test_quality_of_junk(spark):
    good = [prose(r, r) for r in range(100, 220)]
    bad = [" ".join(w + "%%%" for w in prose(r, r).split()) for r in range(220, 280)] + [prose(30, r).upper() + " !!" for r in range(60)]
    rows = [(i, t, int(i < 120)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = quality_classifier.fit_quality(docs, docs.where("doc_id % 3 <> 0"), sample=60)
    held = docs.where("doc_id % 3 = 0").select("label", quality_classifier.quality_score(F.col("text"), model, spark).alias("s")).collect()
    right = [(r.s >= 0.5) == (r.label == 1) for r in held]
    assert np.mean(right) >= 0.9, sorted((r.label, round(r.s, 3)) for r in held)


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(7, 1), (15, 1), (9, 0), (11, 0), (0, None), (None, 1), (777, 1)], "doc_id bigint, label int")
    model = quality_classifier.fit_quality(odd, labels)
    scores = odd.select(quality_classifier.quality_score(F.col("text"), model, spark).alias("s")).collect()
    assert len(scores) == odd.count() and all(0 <= r.s <= 1 for r in scores)
    assert quality_classifier.fit_quality(none, labels.where("false")) == 0.5
    assert quality_classifier.fit_quality(odd, labels.where("label = 1")) > 0.5


def test_numbers_are_no_letters_and_null_ids_are_defined(spark):
    pieces = language.Pieces(MULTI)
    model = language.LanguageModel(["en"], MULTI, 12, np.full((len(pieces.pieces), 1), 1 / len(pieces.pieces)))
    assert [x[0] for x in model.predict(["½ ² Ⅷ", "_ 12 ٣", "½ a", "ª"])] == ["und", "und", "en", "en"]
    ids = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id bigint")
    want = [False] + [zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3, 4)]
    assert [r.held_out for r in ids.select(held(3, 1)).collect()] == want


# --- all -----------------------------------------------------------------------------


def test_empty_tables(spark, none):
    assert judge_documents(none.select("doc_id", "text", "source"), ["doc_id"]).count() == 0
    assert line_dedup.deduplicated(none.select("doc_id", "text")).count() == 0
    assert near_dups.near_duplicates(none.select("doc_id", "text")).count() == 0
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(none, benchmark, ["doc_id"]).count() == 0
    assert packing.pack(none, JSON).count() == 0
    assert filter_urls(none.select(F.lit("u").alias("url")), none.select("host", F.lit("p").alias("path"), F.lit("v").alias("verdict"))).count() == 0


def test_pipeline_stages_bear_odd_documents(spark, odd, none, sf_small):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.packing(spark, odd, sf_small).collect()
    kept = corpus_pipeline.near_dedup(spark, odd, sf_small).select("doc_id").collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in kept) == 2


def test_pipeline_against_brute_force(spark, sf_small):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    docs = list(brute_rules(docs)[0].items())
    docs = [(d, t) for d, _, _, t in brute_lines(docs, 40, 5)]
    same = brute_components(docs)
    docs = [(d, t) for d, t in docs if same[d][1] == d]
    hits = {}
    grams = defaultdict(list)
    for item, t in items:
        own = WORD.findall(t.encode().lower().decode())
        for i in range(max(1, len(own) - 12)):
            grams[tuple(own[i : i + 13])].append(item)
    for d, t in docs:
        own = WORD.findall(t.encode().lower().decode())
        hit = {i + k for n in {len(g) for g in grams} for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in grams for k in range(n)}
        hits[d] = hit and 20 * len(hit) >= len(own)
    docs = {d: t for d, t in docs if not hits[d]}
    plain = Tokenizer.from_file(JSON)
    want = {d: np.array(plain.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for d, t in docs.items()}
    got = defaultdict(bytes)
    for r in corpus_pipeline.run(spark, sf_small).orderBy("doc_id", "start").collect():
        assert r.ids_crc32 == zlib.crc32(r.ids)
        got[r.doc_id] += bytes(r.ids)
    assert dict(got) == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_small, name):
    from checks.compare import connect, difference

    assert difference(QUERIES[name](spark, sf_small), connect(sf_small), SQL[name]) is None


def test_digests(spark, sf_small):
    rows = {r.doc_id: r.kept_sha256 for r in QUERIES["op3_line_dedup"](spark, sf_small).where("n_dropped = 0").collect()}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        if r.doc_id in rows:
            assert rows[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()
