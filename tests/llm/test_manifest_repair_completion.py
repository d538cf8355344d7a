"""Merkle manifest, conversation repair and bin completion against plain versions."""

import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from gradus.llm import completion, manifest, repair

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, arity):
    """Root and the siblings (left, right) of every leaf, level by level."""
    at, paths = list(range(len(leaves))), [[] for _ in leaves]
    while len(leaves) > 1:
        for k in range(len(paths)):
            lo = at[k] // arity * arity
            paths[k].append(("".join(leaves[lo : at[k]]), "".join(leaves[at[k] + 1 : lo + arity])))
            at[k] //= arity
        leaves = [sha("".join(leaves[k : k + arity])) for k in range(0, len(leaves), arity)]
    return leaves[0], paths


def plain_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = [], []
    for g in names:
        own = sorted(groups[g], key=lambda x: x[:3])
        root, paths = plain_tree([x[2] for x in own], arity)
        subroots.append(root)
        out.append((root, own, paths))
    top, over = plain_tree(subroots, arity)
    return sorted(
        ((str(x[3][0]), x[2], root, top, [*p, *over[k]]) for k, (root, own, paths) in enumerate(out) for x, p in zip(own, paths)), key=str
    )


def random_docs(n, seed=0):
    rnd = random.Random(seed)
    lang = lambda: rnd.choice(["en"] * 6 + ["de", "fr", "é", "z", None])
    rows = [(k, rnd.choice(["a", None]), lang(), rnd.choice([None, k]), rnd.choice([None, "", "x" * (k % 9), "ä\n-"])) for k in rnd.sample(range(10 * n), n)]
    return rows + rows[:3] + [(None, None, None, None, None), (None, None, "en", 1, "q")]


@pytest.mark.parametrize("arity,span", [(2, 3), (2, 8), (3, 2)])
def test_manifest_as_plain_trees(spark, monkeypatch, arity, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    rows = random_docs(180)
    docs = spark.createDataFrame(rows, DOCS).withColumn("i", F.lit(7)).withColumn("h", F.lit("x")).withColumn("g", F.lit(None).cast("int")).repartition(3)
    got = manifest.manifest(docs, arity=arity).withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    found = sorted(((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [(x["left"], x["right"]) for x in r["path"]]) for r in got), key=str)
    assert found == plain_manifest(rows, arity)


def test_manifest_of_nothing_one_and_long_text(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    row = (5, "s", "en", None, "word " * 400_000)
    (only,) = manifest.manifest(spark.createDataFrame([row], DOCS)).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == plain_leaf(row) and only["path"] == []


def test_manifest_query_finds_what_was_changed(spark):
    from gradus.llm.queries import op13_manifest

    out = op13_manifest(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        row = docs[r["doc_id"]]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
        assert r["verified"] is not changed and (r["folded_root"] == r["root"]) is r["verified"]


# conversations


def plain_faults(rows):
    """The first fault of every row."""
    out, seen = [], set()
    for role, text in rows:
        kept = text.strip(repair.BLANKS)
        out.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The cheapest edits by trying all of them: at most two rows inserted in any place."""
    faults = plain_faults(rows)

    @lru_cache(None)
    def best(k, state):
        options = []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if k == len(rows):
            if state in ("", "a"):
                return 0, "", ()
            c, audit, text = best(k, after)
            return c + 2, "I" + audit, (({"u": "user", "a": "assistant"}[after], ""), *text)
        role, text = rows[k]
        for inserted in range(3):
            at, head = state, ()
            for _ in range(inserted):
                at = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
                head = (*head, ({"u": "user", "a": "assistant"}[at], ""))
            c, audit, rest = best(k + 1, at)
            options.append((2 * inserted + 3 + c, "I" * inserted + "D" + audit, head + rest))
            if faults[k] in ("b", "d"):
                continue
            price = 2 * inserted + (faults[k] == "t")
            must = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
            c, audit, rest = best(k + 1, must)
            options.append((price + 2 + c, "I" * inserted + "R" + audit, (*head, ({"u": "user", "a": "assistant"}[must], text), *rest)))
            if role[:1] == must or role[:1] == "s" and at == "":
                c, audit, rest = best(k + 1, role[:1])
                options.append((price + c, "I" * inserted + "K" + audit, (*head, (role, text), *rest)))
        return min(options)

    return best(0, ""), faults


LEGAL = {"su", "ua", "au"}


def plain_row(rows, turns):
    (cost, audit, text), faults = plain_repair(tuple(rows))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in text)))


ROLES, TEXTS = ["user", "assistant", "system", "", "tool", "User"], ["Yes.", "No!", "and so", " \t", "", "Why? \n", "Yes.", "é"]


def random_conversations(n, seed):
    rnd, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(ROLES[:2] * 3 + ROLES) if rnd.random() < 0.7 else ("user", "assistant")[turn % 2]
            rows.append((conv, rnd.choice([turn, turn, 2 * turn, None]) if rnd.random() < 0.3 else turn, role, rnd.choice([*TEXTS, f"t{turn}.", f"t{turn}"]), rnd.choice([1] * 8 + [0, 2])))
    return rows


def expected(rows):
    convs = {}
    for c, t, role, text, copies in rows:
        convs.setdefault(c, [])
        convs[c] += [((t is not None, t or 0), role or " " if role is not None else " ", text if text is not None else " ", t)] * copies
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda x: (x[0], x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        out[c] = plain_row([(r, t) for _, r, t, _ in own], [x[3] for x in own])
    return out


def test_repair_as_all_edits(spark):
    rows = [(c, t, r if r != "" else "?", x, n) for c, t, r, x, n in random_conversations(120, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").withColumn("part", F.lit(1)).repartition(3)
    for batch in ("10000", "3"):  # small batches cut conversations into chunks
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == expected(rows)


def test_repair_of_long_conversation_in_chunks(spark):
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice(["Yes.", f"n{t}.", f"n{t}", ""]), 1) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        (got,) = repair.repair(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(got)[1:] == expected(rows)[1]


def test_damage_and_empty(spark):
    rows = [(c, t, "user", "A. b! c?") for c in range(40) for t in [None, *range(9)]] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.damaged(df).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        text = "" if kind == 1 else text.replace(".", "").replace("!", "").replace("?", "") if kind == 2 else text
        want.append((c, t, "user" if kind == 4 else " " if role is None else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=str)
    assert repair.repair(repair.damaged(df.where("false"))).count() == 0
    (gone,) = repair.repair(spark.createDataFrame([(9, 1, "user", "x", 0)], "conv_id long, turn long, role string, text string, copies long")).collect()
    assert tuple(gone) == (9, 0, 0, 0, 0, 0, 0, "", sha(""))


# bin completion


def least_bins(items, capacity):
    """The optimum by dynamic programming over subsets."""
    best = {0: (1, 0)}
    for m in range(1, 1 << len(items)):
        best[m] = min((k, s + x) if s + x <= capacity else (k + 1, x) for i, x in enumerate(items) if m >> i & 1 for k, s in [best[m ^ (1 << i)]])
    return best[(1 << len(items)) - 1][0]


def test_completion_is_optimal_on_small_problems():
    rnd, gained = random.Random(1), 0
    for _ in range(250):
        capacity = rnd.choice([10, 20, 30, 60])
        low = rnd.choice([1, capacity // 4])
        items = [rnd.randint(low, max(low, capacity // rnd.choice([1, 2]))) for _ in range(rnd.randint(1, 10))]
        counts = {x: items.count(x) for x in items}
        solution = completion.complete(counts, capacity)
        used = {}
        for times, filling in solution:
            assert sum(s * n for s, n in filling) <= capacity
            for s, n in filling:
                used[s] = used.get(s, 0) + times * n
        best = least_bins(items, capacity)
        assert used == counts and completion.bins(solution) == best >= completion.fewest(counts, capacity)
        gained += completion.bins(completion.best_fit(counts, capacity)) > best
    assert gained  # the search does better than best fit somewhere


def test_fillings_are_all_undominated_ones():
    left = {9: 1, 7: 2, 4: 2, 3: 3, 1: 1}
    for room in range(15):
        every = [tuple((s, n) for s, n in zip(left, ns) if n) for ns in product(*(range(left[s] + 1) for s in left))]
        every = {f for f in every if sum(s * n for s, n in f) <= room}
        assert set(completion.fillings(left, room, room)) == every


def test_best_fit_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "long words " * 9000), (900_004, "same"), (900_004, "same")], "doc_id long, text string"))
    docs = docs.withColumn("part", F.lit("x")).withColumn("length", F.lit(None).cast("int")).repartition(4)
    rows = docs.select("doc_id", "text").collect()
    got = completion.pack(docs, path, keep_ids=True).collect()
    texts = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}
    assert sum(r["length"] for r in got) == sum(len(texts[r["doc_id"]]) for r in rows)
    for r in got:
        ids = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == ids and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        first = (len(texts[r["doc_id"]]) - 1) % 1024 + 1
        assert (r["start"], r["length"]) == ((0, first) if r["piece"] == 0 else (first + 1024 * (r["piece"] - 1), 1024))
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    counts = {}
    for r in got:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(windows) == completion.bins(completion.complete(counts, 1024)) <= completion.bins(completion.best_fit(counts, 1024))
    assert completion.pack(docs.where("false"), path).count() == 0
