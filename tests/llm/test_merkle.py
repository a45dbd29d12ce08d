import hashlib
import zlib

from quarry.llm import merkle

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(hs, fan):
    levels = [hs]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def proof(levels, i, fan):
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        out.append((level[a : a + fan], i - a))
        i //= fan
    return out


def brute(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, by lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], fan) for g in order}
    upper = tree([trees[g][-1][0] for g in order], fan)
    out = []
    for j, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = proof(trees[g], i, fan) + proof(upper, j, fan)
            now = leaf(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                now = leaf(r | {"n_chars": r["n_chars"] + 1})
            for run, at in steps:
                now = h(*run[:at], now, *run[at + 1 :])
            beside = [x for run, at in steps for k, x in enumerate(run) if k != at]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], upper[-1][0], h(*beside), now, now == upper[-1][0]))
    return sorted(out, key=repr)


def got(df, **options):
    from pyspark.sql import functions as F

    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    out = merkle.verified(df, F.when(hit, merkle.leaf(df, n_chars=F.col("n_chars") + 1)), **options)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    assert sorted((tuple(r) for r in merkle.op13(spark, SF).collect()), key=repr) == brute(rows)


def test_tiers_fans_and_odd_rows(spark):
    """Trees of one to several tiers, groups of every small size, nulls in each column, equal rows, empty and long texts."""
    rows = [dict(zip(COLUMNS, (i, "s", f"g{k}", 3, f"t{i}"), strict=True)) for k in range(1, 19) for i in range(k)]
    rows += [dict(zip(COLUMNS, (i, None if i % 3 else "é", None, None if i % 4 == 0 else i, "" if i % 5 else None), strict=True)) for i in range(70)]
    rows += [dict(zip(COLUMNS, (None, "s", "g3", 1, t), strict=True)) for t in ("a", "b", "b", None)] * 2
    rows += [dict(zip(COLUMNS, (7, "s", "", 9, "ä" * 200_000), strict=True))] * 9
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for fan, depth in ((2, 2), (3, 1), (2, 12), (5, 2)):
        assert got(df, fan=fan, depth=depth) == brute(rows, fan), (fan, depth)


def test_one_row_empty_table_and_clashing_names(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree long, path string, h string, root string"
    assert got(spark.createDataFrame([], schema)) == []
    one = spark.createDataFrame([(1, "s", "en", 2, "ab", 5, "p", "h", "r")], schema)
    assert got(one) == brute([dict(zip(COLUMNS, (1, "s", "en", 2, "ab"), strict=True))])
