"""Token alignment, near-duplicate vectors and conversation repair against brute force, and the cases each must bear."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from accesswatch.llm import alignment, conversations, embedding_dups
from accesswatch.llm.alignment import Aligner, Fragment
from accesswatch.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# Columns that operators use inside, as further columns of the input.
CLASH = ["row", "doc", "key", "id", "n", "a", "b", "part", "pairs", "dim", "list", "block", "home", "conv", "nth", "pass", "kind", "cost"]


def with_clash(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


# --- alignment -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


def brute_alignment(aligner, text):
    """(tokens of both, groups as text, links) of a text encoded in one piece, or None."""
    if not text:
        return None
    a = aligner._a.encode(" " + text, add_special_tokens=False).ids
    b = aligner._b.encode(text)
    if not aligner.sound(" " + text, a, b):
        return None
    spans = []
    for ids, table in ((a, aligner.bytes_a), (b, aligner.bytes_b)):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        spans.append(list(zip(ids, [0, *ends[:-1]], ends)))
    shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = []
    for start, end in zip([0, *shared], shared):
        groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in spans))
    links = Counter((i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e)
    return len(a), len(b), groups, links


def odd_texts(seed=5, n=150):
    r = random.Random(seed)
    letters = [*"ab1.,'é中 \n\t\r  ", "the ", "<s>", "<|endoftext|>", "😀", " x", "▁"]
    texts = [None, "", "a", " ", "\n", "a\nb\n", "a b c", "  a", "x" * 3000, "tie tie tie", "a\r\nb", "a b " * 800]
    texts += ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(n)]
    return texts + [" ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(300)) for _ in range(4)]


def test_units_give_what_the_whole_text_gives(aligner):
    for t in odd_texts():
        units = aligner.units(" " + t) if t else []
        found = aligner.document(units, aligner.learn(set(units))) if units else None
        want = brute_alignment(aligner, t)
        assert (found is None) == (want is None)
        if want:
            n_a, n_b, groups, links = want
            pairs = zip(np.frombuffer(found[4], aligner.kind).tolist(), np.frombuffer(found[5], "<u4").tolist())
            assert found[:4] == (n_a, n_b, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
            assert {(p >> aligner.shift, p & (1 << aligner.shift) - 1): n for p, n in pairs} == links


def test_fragments_join_in_any_tree(aligner):
    """Both sides cut at places of their own, joined in random trees: the same as the whole."""
    r = random.Random(9)

    def tree(parts):
        if len(parts) == 1:
            return parts[0]
        k = r.randint(1, len(parts) - 1)
        return tree(parts[:k]).join(tree(parts[k:]))

    for t in odd_texts(6, 250):
        want = brute_alignment(aligner, t)
        if want is None:
            continue
        a = aligner.ends(aligner._a.encode(" " + t, add_special_tokens=False).ids, aligner.bytes_a)
        b = aligner.ends(aligner._b.encode(t), aligner.bytes_b)
        cuts = sorted(r.randint(0, len(a)) for _ in range(r.randint(1, 8)))
        # The other side is cut near the same byte, a token earlier or later.
        byte = [a[c - 1][1] if c else 0 for c in cuts]
        other = sorted(min(len(b), max(0, sum(e <= x for _, e in b) + r.randint(-1, 1))) for x in byte)
        parts = [
            Fragment.of(a[x:y], b[z:v])
            for x, y, z, v in zip([0, *cuts], [*cuts, len(a)], [0, *other], [*other, len(b)])
        ]
        whole = tree([Fragment(), *parts, Fragment()]).finish()
        assert (whole.n_a, whole.n_b, ";".join(whole.groups), whole.pairs) == (want[0], want[1], ";".join(want[2]), want[3])
        assert whole.n_groups == len(want[2])


def expected_alignment(aligner, rows):
    found = [(d, brute_alignment(aligner, t)) for d, t in rows]
    counts = Counter(p for _, f in found if f for p in f[3])
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((d, n_a, n_b, len(groups), sum(links.values()), best, total, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"long": 40, "chunk": 16, "arity": 2, "block": 300}])
def test_alignment_of_documents(spark, aligner, sizes):
    """Short texts, and the same in chunks over tasks with the counts in several blocks; repeats, a null id."""
    rows = list(enumerate(odd_texts(7, 60)))
    rows += [rows[6], (None, "a b c"), (None, None)]
    docs = with_clash(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = alignment.align(docs, A, B, **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == expected_alignment(aligner, rows)


def test_alignment_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    found = alignment.align(docs, A, B)
    assert found.count() == 0 and found.columns[0] == "doc_id"


def test_alignment_query(spark, sf_small, aligner):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows]
    found = QUERIES["op11_tokenizer_alignment"](spark, sf_small).collect()
    short = {d for d, t in rows if len(t or "") < 3000}
    want = {r[0]: r[:5] + r[7:] for r in expected_alignment(aligner, [(d, t) for d, t in rows if d in short])}
    assert {r.doc_id for r in found} == {d for d, _ in rows}
    for r in found:
        if r.doc_id in short:
            assert (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == want[r.doc_id]


# --- vectors -------------------------------------------------------------------------


def brute_vectors(rows, least):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v, _ in rows]
    links = defaultdict(set)
    for (i, (p, _, x)), (j, (q, _, y)) in itertools.combinations(enumerate(rows), 2):
        if None in (p, q, x, y) or x != y or unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]):
            continue
        if unit[i] @ unit[j] >= least:
            links[i].add(j)
            links[j].add(i)
    component = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in rows:
        for i, near in links.items():
            for j in near:
                component[rows[i][0]] = min(component[rows[i][0]], component[rows[j][0]])
    return sorted(
        [(p, len(links[i]), component.get(p), p is None or component[p] == p) for i, (p, _, _) in enumerate(rows)], key=str
    )


def some_vectors(n, dim, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(centres[i % 6] + spread * r.normal(size=dim) * (i % 5)).tolist() for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("sizes", [{}, {"block": 7, "most_lists": 3, "parts": 3, "codes": 5, "sample": 40}])
def test_near_vectors(spark, kind, sizes):
    """Groups of near copies, chains, exact copies, odd vectors and lengths, in one block and in many."""
    rows = [(i, np.float32(v).tolist(), i % 2) for i, v in enumerate(some_vectors(240, 16, 1, 0.08))]
    rows += [(300 + i, rows[3][1], 1) for i in range(30)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] + [1.0] * 15, 0), (404, [None] + [1.0] * 15, 0)]
    rows += [(405, [float("inf")] * 16, 0), (406, rows[0][1], None), (None, rows[0][1], 0), (407, rows[0][1][:9], 0), (408, rows[0][1][:9], 0)]
    rows += [rows[5], (409, np.float32(np.array(rows[5][1]) * 4).tolist(), 1)]
    table = with_clash(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int"))
    found = embedding_dups.near_vectors(table, least=0.98, **sizes)
    want = brute_vectors(rows, 0.98)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert 20 < sum(n > 0 for _, n, _, _ in want) and any(n >= 29 for _, n, _, _ in want)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dups.near_vectors(empty).collect() == []
    odd = spark.createDataFrame([(1, None, 0), (2, [0.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_dups.near_vectors(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bounds_lose_nothing():
    """Each pair within the radius passes both bounds, whatever the quantiser."""
    x = np.array(some_vectors(400, 12, 3, 0.05))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dups.fit_quantiser(x, 9, 4, 3, rounds=1)
    home, near = q.lists(x, 0.2)
    codes, lost = q.encode(x, home)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for at in range(len(q.centres)):
        mine = (home == at).nonzero()[0]
        table = np.sqrt(q.distances(x, at, codes[mine]))
        assert (np.abs(table - d[:, mine]) <= lost[mine][None] + embedding_dups.SLACK).all()
        assert near[:, at][(d[:, mine] <= 0.2).any(1)].all()


# --- conversations -------------------------------------------------------------------


def brute_repair(rows):
    """Least (cost, audit) from the end, by layers of rows and repeated steps over inserts."""
    lattice = conversations.Lattice(rows)
    layer = None
    for i in range(len(rows), -1, -1):
        new = {q: (0, "") for q in (0, 3)} if layer is None else {}
        for q in range(4):
            for letter, w, to in lattice.forward(4 * i + q):
                if to // 4 == i + 1 and to % 4 in layer:
                    cost, audit = layer[to % 4]
                    new[q] = min(new.get(q, (1 << 60, "")), (cost + w, letter + audit))
        for _ in range(4):
            for q, to in conversations._NEXT.items():
                if to in new:
                    new[q] = min(new.get(q, (1 << 60, "")), (new[to][0] + 3, "I" + new[to][1]))
        layer = new
    return layer[0]


def test_cheapest_repairs():
    for n in range(4):
        for rows in itertools.product("suaxSUAXd", repeat=n):
            assert conversations.cheapest("".join(rows)) == brute_repair("".join(rows))
    r = random.Random(2)
    for _ in range(400):
        rows = "".join(r.choices("suaxSUAXd", k=r.randint(4, 60)))
        assert conversations.cheapest(rows) == brute_repair(rows)


def test_search_meets_in_the_middle():
    """Neither search does the whole lattice of a sound conversation."""
    rows = "ua" * 500
    assert conversations.cheapest(rows) == (0, "K" * 1000)


CONV = "conv_id bigint, turn bigint, role string, text string"


def expected_turns(rows):
    """Summary and repaired turns of one conversation's rows (turn, role, text)."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, letters, faults = set(), "", Counter()
    for _, role, text in rows:
        body, letter = text.encode().strip().decode(), role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        letters += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = brute_repair(letters)
    out, i, state = [], 0, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else rows[i][1:]
        state = conversations._KEPT[role[0]][state] if edit == "K" else conversations._NEXT[state]
        out.append((role if edit == "K" else {2: "user", 3: "assistant"}[state], text))
        i += edit != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest), out


def some_conversations():
    r = random.Random(4)
    texts = ["Yes.", "No!", "Cut off", "", " \t\x0b", "Why?  ", "Two\nlines.", "ü ", "long " * 20_000 + ".", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(600)]
    rows += [(101, None, "user", "A."), (101, None, "assistant", "B."), (101, 9, "user", "A."), (101, 2, "user", "C."), (101, 2, "assistant", "C.")]
    rows += [(None, 3, "user", "A."), (None, 1, "system", "S."), (102, None, None, None)] + [rows[0]] * 3
    return rows


def test_conversations(spark):
    rows = some_conversations()
    table = with_clash(spark.createDataFrame(rows, CONV)).repartition(7)
    groups = defaultdict(list)
    for c, *row in rows:
        groups[c].append(row)
    want = {c: expected_turns(g) for c, g in groups.items()}
    plans = {r[0]: tuple(r)[1:] for r in conversations.repair_plans(table).collect()}
    assert plans == {c: w[0] for c, w in want.items()}
    turns = defaultdict(list)
    for r in sorted(conversations.repaired_turns(table).collect(), key=lambda r: r.place):
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_absent_rows_only_name_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (2, 0, "user", "Gone."), (1, 1, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, CONV).withColumn("gone", F.expr("if(conv_id = 2, true, null)"))
    found = {r[0]: tuple(r)[1:] for r in conversations.repair_plans(table, absent=F.col("gone")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[2] == (0, 0, 0, 0, 0, 0, "", nothing) and found[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert conversations.repair_plans(table.where("false"), absent=F.col("gone")).count() == 0
