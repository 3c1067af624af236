"""Small cases of every operator: nulls, empty and long values, ties, repeated rows, empty tables, clashing columns, hot groups."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrain.llm import queries as Q
from loomgrain.llm import buckets, components, distinctive, leakage, mixing, near_dup, parse_check, set_join, source_kind, term_counts, visual_form

# ---------------------------------------------------------------- 1


def test_two_poisson_separates_elite_counts():
    counts = [np.array([1.0, 8.0, 9.0, 10.0]), np.array([2.0])]
    fit = distinctive.fit_two_poisson(counts, [np.array([300.0, 20.0, 30.0, 20.0]), np.array([5.0])], np.array([700.0, 95.0]), 200)
    assert 0.05 < fit[0, 0] < 0.1 and 8 < fit[0, 1] < 10 and fit[0, 2] < 1
    p, hi, lo = fit[0]
    assert distinctive._elite(9.0, p, hi, lo) > 0.99 and distinctive._elite(1.0, p, hi, lo) < 0.05
    assert np.isfinite(fit).all() and (fit[:, 1] > fit[:, 2]).all()
    assert distinctive.fit_two_poisson([], [], np.array([])).shape == (0, 3)


def test_posterior_falls_with_frequency():
    """The same count speaks for the elite where a term is rare, and less and less where it is common."""
    holders = np.array([2, 8, 40, 200, 600], float)
    fit = distinctive.fit_two_poisson([np.array([1.0, 2.0, 3.0])] * 5, [np.array([0.5, 0.3, 0.2]) * h for h in holders], 2000 - holders)
    posterior = distinctive._elite(2.0, *fit.T)
    assert (np.diff(posterior) < 0).all() and posterior[0] > 0.8 and posterior[-1] < 0.5


def test_counts_are_not_cut_off(spark):
    rows = [(i, [1], {1: w}, "x") for i, w in enumerate([1.0, 500.0, 70.0, float("nan"), -2.0, 0.0])] + [(50 + i, [], None, "x") for i in range(20)]
    stats = distinctive.term_statistics(distinctive.occurrences(spark.createDataFrame(rows, T))).first()
    assert stats.df == 6 and sum(b["mass"] for b in stats.histogram) == pytest.approx(571.0) and len({b["bin"] for b in stats.histogram}) == 4
    assert all(0 <= r.elite <= 1 for r in distinctive.score_terms(spark.createDataFrame(rows, T)).where("not isnan(w)").collect())


T = "fn_id long, ngram_hashes array<bigint>, weighted_ngram_hashes map<bigint,double>, term string"


def test_term_scores_and_edges(spark):
    rows = [(1, [1, 2, 2, None], {1: 6.0, 2: None}, "x"), (2, [1, 2, 3], {3: 9.0}, "x"), (3, None, None, "x"), (4, [], {}, "x"), (5, [1], {1: 1.0}, "x"), (6, [2, 1], None, "x")]
    df = spark.createDataFrame(rows, T)
    scores = distinctive.score_terms(df)
    got = {(r.id, r.term): r for r in scores.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (5, 1), (6, 1), (6, 2)}
    assert got[(1, 1)].score == pytest.approx(6 * np.log(6 / 4)) and got[(1, 2)].score == pytest.approx(np.log(2)) and all(0 <= r.elite <= 1 for r in got.values())
    assert {(r.id, r.term) for r in distinctive.standing_out(scores).collect()} == {(1, 1)}
    assert distinctive.standing_out(distinctive.score_terms(df.limit(0))).count() == 0


def test_hot_terms_are_salted_without_loss(spark):
    df = spark.range(6000).select(F.col("id").alias("fn_id"), F.array(F.lit(7), F.col("id") % 5 + 100).cast("array<bigint>").alias("ngram_hashes"), F.create_map().cast("map<bigint,double>").alias("weighted_ngram_hashes"))
    assert distinctive.score_terms(df, hot_share=0.001).count() == 12000


# ---------------------------------------------------------------- 2


def _plain_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("cell", [10, 60, 10_000])
def test_components_equal_union_find(spark, cell):
    rnd = random.Random(cell)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, 3000 + i) for i in range(150)] + [(5, None), (None, None), (9999, 9999)]
    links += links[:20] + [(b, a) for a, b in links[:20]]
    got = {r.id: r.group_id for r in components.connected_groups(spark.createDataFrame(links, "a long, b long"), cell_links=cell).collect()}
    assert got == _plain_components(links)


def test_components_of_nothing_and_of_lists(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components.connected_groups(empty).columns == ["id", "group_id"] and components.connected_groups(empty).count() == 0
    lists = spark.createDataFrame([([1, None, 2, 3],), ([4],), ([],), (None,), ([None],), ([5, 5],)], "m array<bigint>")
    assert {(r.a, r.b) for r in components.chain_links(lists, "m").collect()} == {(1, 2), (2, 3), (5, 5)}


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_local_roots_are_groups(links):
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    vertex, root = components.local_roots(a, b)
    parent = _plain_components([(x, y) for x, y in links] or [])
    groups = defaultdict(set)
    for v, r in zip(vertex.tolist(), root.tolist()):
        groups[r].add(v)
    want = defaultdict(set)
    for v in set(a.tolist()) | set(b.tolist()):
        want[parent.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# ---------------------------------------------------------------- 3 and 7

ARRAYS = "ngram_hashes array<bigint>, structural_markers array<bigint>, semantic_markers array<bigint>, skeleton_hashes array<bigint>, ingested_at timestamp, cid string, key string"


def _families(seed, families=12, size=7):
    rnd, rows, key = random.Random(seed), [], 1
    for _ in range(families):
        base, skel = [rnd.randrange(1 << 60) for _ in range(24)], [rnd.randrange(1 << 60) for _ in range(20)]
        for _ in range(size):
            g = [x if rnd.random() > 0.12 else rnd.randrange(1 << 60) for x in base]
            s = [x if rnd.random() > 0.15 else rnd.randrange(1 << 60) for x in skel]
            rows.append((key, g, [rnd.randrange(5) for _ in range(3)], [1], s))
            key += 1
    rows += [(key, rows[0][1], rows[0][2], rows[0][3], rows[0][4]), (key + 1, [1, 2], None, None, None), (key + 2, None, None, None, None), (key + 3, [*rows[1][1], None, rows[1][1][0]], rows[1][2], [None, 1], rows[1][4]), (None, rows[0][1], None, None, None)]
    rows += [(key + 4 + i, list(range(50, 62)), None, None, []) for i in range(3)]
    return rows


def _frame(spark, rows, key="fn_id"):
    return spark.createDataFrame([(*r, None, "clash", "clash") for r in rows + rows[:5]], f"{key} long, {ARRAYS}")


def _set(x):
    return {v for v in x or [] if v is not None}


def _overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similar_pairs_equal_brute_force(spark):
    fns, lib = _families(1), [(k, [*g[:20], *range(3)], s, m, t) for k, g, s, m, t in _families(1)[:6]]
    lib = [(10_000 + i, *r[1:]) for i, r in enumerate(lib)]
    items = {r[0]: (side, _set(r[1]), {("g", x) for x in _set(r[1])} | {("s", x) for x in _set(r[2])} | {("m", x) for x in _set(r[3])}) for side, rows in ((0, fns), (1, lib)) for r in rows if r[0] is not None}
    keys = sorted(k for k, (_, g, _) in items.items() if len(g) >= 8)
    true = {(a, b) for a in keys for b in keys if a < b and items[a][0] + items[b][0] < 2 and _overlap(items[a][2], items[b][2]) >= 0.6}
    records = set_join.item_records(_frame(spark, fns), "fn_id", 0, "ingested_at", 8).unionByName(set_join.item_records(_frame(spark, lib, "example_id"), "example_id", 1, None, 8))
    got = [(r.key_a, r.key_b) for r in set_join.similar_pairs(records, block=2).collect()]
    assert len(got) == len(set(got)) and set(got) == true and len(true) > 100
    assert set_join.similar_pairs(records.limit(0)).count() == 0
    classes = {k: min(q for q in keys if items[q][2] == items[k][2]) for k in keys}
    pairs = {(classes[a], classes[b]) for a, b in true if classes[a] != classes[b]}
    links = {r.key: (r.class_id, r.links) for r in set_join.record_links(records).collect()}
    joined = {tuple(sorted(p)) for p in pairs}
    assert links == {k: (classes[k], sum(classes[k] in p for p in joined)) for k in keys}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_groups_equal_brute_force(spark, seed):
    rows = _families(seed)
    sets = {r[0]: (_set(r[1]), _set(r[4])) for r in rows if r[0] is not None and len(_set(r[1])) >= 8}
    links = [(a, b) for a in sets for b in sets if a < b and (_overlap(sets[a][0], sets[b][0]) + _overlap(sets[a][1], sets[b][1])) / 2 >= 0.7]
    got = {r.fn_id: r.group_id for r in near_dup.near_duplicate_groups(_frame(spark, rows)).collect()}
    assert got == _plain_components(links) and links
    assert near_dup.near_duplicate_groups(_frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0.5, 0.7, 0.85])
def test_pigeonhole_probes_lose_no_pair(limit):
    rnd = random.Random(int(limit * 100))
    part = {x: rnd.randrange(1000) * 100 + x // near_dup.partition_bits(limit) for x in range(60)}
    freq = {x: 2 + x * x % 47 for x in range(60)}
    met = 0
    for _ in range(300):
        a = {rnd.randrange(60) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14, 25]))}
        b = set(a)
        for _ in range(rnd.randrange(7)):
            b.discard(rnd.choice(sorted(b | {0})))
            b.add(rnd.randrange(60))
        groups = {x: part[x - x % near_dup.partition_bits(limit)] for x in range(60)}

        def probes(s):
            return near_dup.probes([groups[x] for x in s], list(s), [freq[x] for x in s], len(s), limit)

        if len(a & b) >= limit * len(a | b):
            met += 1
            pa, pb = probes(a), probes(b)
            asked = {p for p, q in pa if q} & {p for p, _ in pb} | {p for p, q in pb if q} & {p for p, _ in pa}
            assert asked, (a, b)
    assert met > 50


def test_probes_of_a_long_record_are_bounded():
    n = 10_000
    found = near_dup.probes([i // 3 for i in range(n)], list(range(n)), [2 + i % 900 for i in range(n)], n, 0.7)
    assert len(found) <= 1.5 * n and any(q for _, q in found)


def test_thresholds_avoid_costly_partitions():
    got = near_dup.allocate_thresholds([3, 3, 3, 1], [(1e6, 1e7), (1.0, 3.0), (2.0, 5.0), (9.0, 9.0)], 3)
    assert got[0] == -1 and sum(t + 1 for t in got) >= 3 and got == [-1, 1, 0, -1]
    assert near_dup.allocate_thresholds([], [], 0) == []


def test_a_full_bucket_is_dealt_out(spark):
    """10^5 members of one bucket, all in groups of their own: no task holds 5 % of the pairs' rows."""
    from loomgrain.skew import hot_join, hot_keys, with_stats

    n = 100_000
    rows = spark.range(n).select(F.when(F.col("id") < n * 0.9, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("m"))
    assert hot_keys(rows, "k", floor=1000) == [7]
    stats = with_stats(rows.repartition(64), "k", {"n": F.count("*")}, floor=1000)
    largest = lambda df: df.where("k = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    most = largest(stats)
    assert most < 0.05 * n and stats.where("k = 7").first().n == 0.9 * n and stats.count() == n
    joined = hot_join(rows.repartition(64), spark.createDataFrame([(7, "x"), (n - 1, "y")], "k long, v string"), "k", "left", floor=1000)
    assert largest(joined) < 0.05 * n and joined.where("v = 'x'").count() == 0.9 * n and joined.count() == n
    assert hot_keys(rows.limit(0), "k") == []


def test_hot_paths_give_the_same_rows(spark):
    rows = _families(2)
    plain = {r.fn_id: r.group_id for r in near_dup.near_duplicate_groups(_frame(spark, rows)).collect()}
    assert plain == {r.fn_id: r.group_id for r in near_dup.near_duplicate_groups(_frame(spark, rows), floor=2).collect()}
    records = set_join.item_records(_frame(spark, rows), "fn_id", 0, "ingested_at", 8)
    assert sorted(set_join.similar_pairs(records).collect()) == sorted(set_join.similar_pairs(records, block=3, floor=2).collect())


def test_bucket_groups_equal_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(b, m) for b in range(8) for m in rnd.sample(range(60), 25)]
    near = lambda pairs: pairs.where("abs(a - b) <= 2")
    links = {(x, y) for b in range(8) for x in (m for k, m in rows if k == b) for y in (m for k, m in rows if k == b) if x < y and y - x <= 2}
    df = spark.createDataFrame(rows, "bucket long, member long")
    assert {r.id: r.group_id for r in buckets.bucket_groups(df, "bucket", "member", near).collect()} == _plain_components(links)
    every = {(x, y) for b in range(8) for x in (m for k, m in rows if k == b) for y in (m for k, m in rows if k == b) if x < y}
    assert {(r.a, r.b) for r in buckets.bucket_pairs(df, "bucket", "member", block=4).collect()} == every
    assert {(r.a, r.b) for r in buckets.bucket_pairs(df, "bucket", "member", block=4, floor=3).collect()} == every
    assert {r.id: r.group_id for r in buckets.bucket_groups(df, "bucket", "member", near, block=3, floor=3).collect()} == _plain_components(links)


# ---------------------------------------------------------------- 4


def test_value_frequencies(spark):
    rows = [(1, ["A.b ", "a.B", None, " "], ["c"]), (64, ["\ta.b"], None), (65, None, []), (-3, ["a.b"], ["d", "d"]), (None, ["zz"], None)] + [(100 + i, [], None) for i in range(6)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, x array<string>, y array<string>, value string")
    got = {r["value"]: (r.occurrences, r.records, r.mark) for r in term_counts.value_frequencies(df, "id", ["x", "y"]).collect()}
    assert got == {"a.b": (4, 3, "common"), "c": (1, 1, "rare"), "d": (2, 1, "rare")}
    repeated = term_counts.value_frequencies(df.unionByName(df), "id", ["x", "y"]).where("value = 'a.b'").first()
    assert repeated.records == 3
    assert term_counts.value_frequencies(df.limit(0), "id", ["x", "y"]).count() == 0


def test_bitmaps_merge(spark):
    a = spark.range(0, 200_000, 3).select(F.col("id"), F.array(F.lit("v"), F.lit("w")).alias("x"))
    b = spark.range(0, 200_000, 2).select(F.col("id"), F.array(F.lit("v")).alias("x"))
    one, two = term_counts.bitmaps(a, "id", ["x"]), term_counts.bitmaps(b, "id", ["x"])
    both = {r["value"]: (r.occurrences, r.records) for r in term_counts.frequencies(term_counts.merged(one, two)).collect()}
    assert both == {"v": (66_667 + 100_000, len(set(range(0, 200_000, 3)) | set(range(0, 200_000, 2)))), "w": (66_667, 66_667)}
    assert one.agg(F.max(F.size("words"))).first()[0] == 1024 and one.where("value = 'v'").count() == 4


# ---------------------------------------------------------------- 5

CODE = "import {{ a }} from './{0}';\n\nexport function {0}({1}) {{\n  if (!{1}) {{ return null; }}\n  const {2} = {1}.map((x) => x + {3});\n  for (const y of {2}) {{ send(y, '{0}'); }}\n  try {{ {0}Store.put({2}); }} catch (e) {{ log(e); }}\n  return {2};\n}}\n"


BODY = CODE + "export function extra{3}({1}) {{\n  while ({1}) {{ {0}.step({1}, {{ limit: {3} }}); }}\n}}\n"


def test_kinds_of_source_files(spark):
    lib = CODE.format("lib", "q", "r", 9) + "const z = lib([1, 2]);\n"
    other = "import x from 'y';\nlet {0} = new Map();\nif ({0}.size > {1}) {{ throw {0}; }}\n{0}.forEach((v, k) => {{ drop(k, v); }});\n"
    tool = "// Made by toolgen, touch the template instead\n"
    rows = [
        (3, "a", "src/z.js", "var a=1;" * 100), (4, "a", "src/d.py", "DATA = [" + ", ".join(str(i) for i in range(200)) + "]\n"),
        (5, "a", "third_party/l/m.ts", lib), (6, "b", "src/util/m2.ts", lib.replace("\n", "\r\n") + "// kept\n"),
        (7, "a", "src/hand.ts", "// the ids generated upstream are never reused\nconst generated = call(1);\nlog('DO NOT EDIT, code generated');\n"), (8, "b", "src/none.ts", None), (9, "b", "src/empty.ts", ""), (None, "b", "x.ts", "x"),
        (10, "c", "src/lone.ts", tool + other.format("lone", 4)), (11, "c", "src/byhand.ts", "// Written by the team\n" + other.format("hand", 5) + "export const q = 1 + hand.size * 2 - call(a, b);\n"), (12, "b", "src/only.ts", "// only a comment\n"),
        (13, "b", "src/page.ts", "<html><body>not here</body></html>\n"), (14, "c", "src/page.ts", "<html><body>not here</body></html>\n"),
    ] + [(20 + i, "t", f"src/f{i}.ts", tool + BODY.format(f"n{i}", f"p{i}", f"q{i}", i)) for i in range(5)] + [(30, "b", "src/own.ts", "export const f = (a) => { while (a) { a = next(a); } return a; };\n" * 3), (20, "t", "src/f0.ts", tool + BODY.format("n0", "p0", "q0", 0))]
    files = spark.createDataFrame([(*r, "clash", 1) for r in rows], "file_id long, repo string, file_path string, content string, cluster string, cid long")
    want = {3: {"minified"}, 4: {"data"}, 5: {"vendored"}, 6: {"vendored"}, 10: {"generated"}, **{20 + i: {"generated"} for i in range(5)}}
    for floor in (20_000, 2):
        got = {r.file_id: r for r in source_kind.source_kinds(files, floor=floor).collect()}
        kinds = {k: {x for x in ("generated", "minified", "vendored", "data") if r[x]} for k, r in got.items()}
        assert kinds == {k: want.get(k, set()) for k in (3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, *range(20, 25), 30)}
    assert got[5].declared and not got[11].declared
    assert source_kind.source_kinds(files.limit(0)).count() == 0


def test_kinds_hold_a_piece_of_a_batch(spark, monkeypatch):
    """What a worker makes of its texts follows neither the rows of an Arrow batch nor the words it has seen."""

    class Scan:
        def mapInPandas(self, look, _):
            return lambda batch: look(iter([batch.to_pandas()]))

        def mapInArrow(self, look, _):
            return lambda batch: look(iter([batch]))

    monkeypatch.setattr(source_kind, "spread", lambda rows, key: Scan())
    look = source_kind.file_evidence(spark.createDataFrame([], "file_id long, repo string, file_path string, content string"))
    texts = [BODY.format(f"n{i % 9}", f"p{i % 9}", f"q{i % 9}", i % 9) * 10 for i in range(1500)]
    few, many = (pa.RecordBatch.from_pydict({"file_id": list(range(n)), "repo": ["r"] * n, "file_path": [f"src/{i}.ts" for i in range(n)], "content": texts[:n]}) for n in (400, 1500))
    rows, peaks = [], []
    for batch in (few, many):
        tracemalloc.start()
        rows.append(sum(len(out) for out in look(batch)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert rows == [400, 1500] and peaks[1] < 1.5 * peaks[0]

    for i in range(30):
        source_kind.describe("a.py", f"DATA = '{i}{'x' * 400_000}'\n")
    assert sum(map(len, source_kind._words)) < 6_000_000


def test_kinds_of_batches_with_empty_and_long_texts():
    texts = ["", "x" * (source_kind.PIECE_BYTES + 5), "é", "", "y" * (source_kind.PIECE_BYTES - 1), "z"] + ["w" * 1000] * 3000
    batches = [pa.RecordBatch.from_pydict({"file_id": ids, "content": [texts[i] for i in ids]}, pa.schema([("file_id", pa.int64()), ("content", pa.string())])) for ids in ([], [0, 1, 2], [3], list(range(4, len(texts))))]
    pieces = list(source_kind._pieces(iter(batches)))
    assert [(i, t) for p in pieces for i, t in zip(p["file_id"], p["content"])] == list(enumerate(texts))
    assert all(sum(map(len, p["content"][:-1])) < source_kind.PIECE_BYTES for p in pieces)


# ---------------------------------------------------------------- 6

GOOD = {
    "ts": ["", "// only\n", "\ufeffconst a = 1;\r\nlet b = `x ${a + `${1}`} {`;\n", "const r = /[({]a\\/+/g;\nconst d = a / b / c;\n", "// <<<<<<< no\nconst t = `\n<<<<<<< in text\n`;\n", "export async function f<T>(a: Record<string, number>): Promise<T | null> {\n  return a as unknown as T;\n}\n", "interface A { b?: string; }\ntype C = A | null;\nexport const enum D { E }\nlet x = y!;\n", "const f = async (a, b) => ({ ...a, b });\nlabel: for (const x of y) { continue label; }\n", "a = b\nc = d\n++e\nif (x) y()\nelse z()\n", "class A { get b() { return 1; } static async *c() { yield 1; } #d = 2; }\n", "import type { A } from 'a';\nexport { A as B };\n"],
    "tsx": ["const a = <div className=\"x\" on={() => { go(); }}>don't {b} <br/> <>z</></div>;\nconst c = a < b;\n"],
    "js": ["!function(){var a=[1,2];return a[0]>1?a:void 0}();\n", "const o = { if: 1, of: 2, get: 3 };\no.return(1);\n", "#!/usr/bin/env node\nlet a = 1;\n"],
    "rs": ["", "/* a /* b */ c */\npub struct A<'a> { b: &'a str }\n", "fn f<'a>(x: &'a str) -> char { let c = 'x'; let d = '\\''; let e = \"multi\nline\"; c }\n", "const A: &[(&str, i32)] = &[(\"a\", 1)];\n#[derive(Debug)]\nenum B { C(u8) }\nmacro_rules! m { ($x:expr) => { $x }; }\n", "fn g() { let r = r#\"a \"quoted\" b\"#; match r { x if x.len() > 1u32 as usize => {} _ => {} } }\n", "use crate::a::B;\nimpl B { pub async fn c(&mut self) -> Option<String> { None } }\n"],
    "py": ["", "x = f\"{a['b']}\" f'{f\"{c!r:>{w}}\"} {d}'\ny = f'{f'{e}' + \"}\"}'\n", "from a import *\n", "try:\n    a\nexcept B:\n    c\nelse:\n    d\nfinally:\n    try: e\n    finally: f\n", "if g(lambda: 1, 2):\n    h\n", "# only\n", "def f(a, b: int = 1, *c, **d) -> None:\n    \"\"\"It isn't {open.\"\"\"\n    return [q for q in a if q != 1]\n", "x = (1,\n  2)\nif x: y = 1\nelse:\n\ty = 2\n", "class A:\n    async def b(self):\n        async with c as d:\n            await d\n", "match x:\n    case 1: pass\nlambda a: a\nd = {'a': 1, 'b': lambda x: x}\n", "s = 'a' \\\n    'b'\n"],
}
BAD = {
    "ts": ["function f() {\n", "const a = [1, 2;\n", "const a = 'open;\n", "const a = `open\n", "/* open\n", "<<<<<<< HEAD\nlet a = 1;\n=======\nlet a = 2;\n>>>>>>> x\n", "def f(a):\n    pass\n", "use crate::a::B;\n", "<!DOCTYPE html>\n<html></html>\n", "{\n  \"a\": 1\n}\n", "   1 | import { a } from 'a';\n", "let a = 1;\n[... 10 more lines omitted ...]\n", "const a = 1abc;\n", "export function f(a)\n", "let a =\n", "}\n", "Here is the file:\n"],
    "jsx": ["const a = <div><b></div></b>;\n", "const a = <div>;\n"],
    "js": ["interface A { b: string; }\n", "function f(a: string) { return a; }\n"],
    "rs": ["fn f() {\n", "let s = \"open;\n", "import a_kit\n", "export function f() {}\n", "--- a/x\n+++ b/x\n", "fn f() { let a = [1, 2); }\n", "/* open\n", "fn f() -> u8 { 1 }\nNone\n", "{\n \"a\": 1\n}\n"],
    "py": ["try:\n    a\nb = 1\n", "try:\n    a\n", "def f():\n    try:\n        a\n    b\n", "x = f'{a'\n", "def f(a)\n    pass\n", "def f(a):\npass\n", "x = 'open\n", "x = (1,\n", "  x = 1\n", "for a in b:\n", "export async function f() {\n}\n", "<<<<<<< HEAD\nx = 1\n", "if a:\n        b\n    c\n", "const a = 1;\n", "let x = 1\n"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid_texts_parse(ext):
    assert [(t, w) for t in GOOD[ext] if (w := parse_check.what_is_broken(t, ext))] == []


@pytest.mark.parametrize("ext", BAD)
def test_broken_texts_are_flagged(ext):
    assert [t for t in BAD[ext] if not parse_check.what_is_broken(t, ext)] == []


@given(st.text(max_size=80), st.sampled_from(sorted(parse_check.LANGUAGES)))
@settings(max_examples=300, deadline=None)
def test_any_text_has_a_verdict(text, ext):
    why = parse_check.what_is_broken(text, ext)
    assert why is None or isinstance(why, str)


def test_long_and_missing_texts(spark):
    assert parse_check.what_is_broken("a(" * 100_000, "js") and parse_check.what_is_broken("x = [" + "1, " * 200_000 + "]\n", "py") is None
    rows = [(1, "r", "a.py", "x ="), (1, "r", "a.py", "x ="), (2, "r", "b.py", None), (3, None, None, "x"), (4, "r", "c.rs", "fn a() {}")]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, repo string, file_path string, content string, language string")
    checked = parse_check.checked_files(files)
    assert {r.file_id for r in checked.where("problem is not null").collect()} == {1}
    rates = {(r.repo, r.language): (r.files, r.broken) for r in parse_check.broken_rates(checked).collect()}
    assert rates[(None, None)] == (4, 1) and rates[("r", "python")] == (2, 1) and rates[("(none)", "(none)")] == (1, 0)


# ---------------------------------------------------------------- 8


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=2), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_fm_index_finds_every_occurrence(symbols, phrases):
    seq = np.array([*symbols, 0], np.int64)
    index = leakage.FMIndex(seq, 4)
    low, high = index.search(np.array(phrases, np.int64))
    for p, lo, hi in zip(phrases, low, high):
        got = sorted(index.locate(np.arange(lo, hi)).tolist()) if hi > lo else []
        assert got == [i for i in range(len(seq) - 1) if seq[i : i + 2].tolist() == p]


def test_leaked_spans_and_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, f"x {item} y"), (2, f"x {item.upper().replace(' ', ' - ')}! and {item}"), (3, "alpha beta gamma"), (4, None), (5, ""), (None, item), (6, "аlphа beta\u200b gamma delta epsilon"), (1, f"x {item} y"), (7, "pad " * 500 + item + " pad" * 500)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(10, item), (11, "alpha beta gamma delta epsilon"), (12, "short"), (13, None), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in leakage.leaked_spans(d, i, min_words=5, shard_words=50).collect()}
    short = {s for s in got if s[0] != 7}
    assert short == {(1, 10, 1, 8), (1, 11, 1, 5), (2, 10, 1, 8), (2, 10, 10, 17), (2, 11, 1, 5), (2, 11, 10, 14), (6, 10, 0, 4), (6, 11, 0, 4)}
    assert {(s[1], s[2]) for s in got if s[0] == 7} >= {(10, 500), (11, 500)}  # cut into shards: spans may come in pieces that touch
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, min_words=5, shard_words=50, block_words=1).collect()} == {(a, b) for a, b, _, _ in got}
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


@given(st.lists(st.floats(0, 1), min_size=1, max_size=40), st.integers(0, 1000))
@settings(max_examples=200, deadline=None)
def test_pivotal_rounding_keeps_the_sum(p, seed):
    p = np.array(p)
    out = mixing.settle(p, np.random.default_rng(seed))
    assert abs(out.sum() - p.sum()) < 1e-6 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and out.min() >= -1e-9 and out.max() <= 1 + 1e-9


def test_pivotal_rounding_is_unbiased():
    p = np.array([0.2, 0.5, 0.9, 0.4])
    mean = np.mean([mixing.settle(p, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix_reaches_its_shares(spark):
    docs = [(i, "word " * (5 + i % 17), "Big ", "c") for i in range(900)] + [(1000 + i, "text " * 12, "small", "c") for i in range(60)] + [(5000, None, "big", "c"), (5001, "", "big", "c"), (None, "x", "big", "c"), (5002, "x", None, "c"), (3, "word " * 8, "big", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string")
    plans = spark.createDataFrame([("p", "big", 3.0, 1), ("p", "SMALL", 2.0, 4), ("q", "big", 1.0, None), ("q", "gone", 1.0, 2), ("q", None, 1.0, 1), ("p", "big", None, 1)], "plan_id string, source string, target_share double, max_repeats int")
    drawn, targets = mixing.draw(d, plans, Q.VOCABULARY, leaf=50, fan=3)
    drawn = drawn.cache()
    shares = {(r.plan_id, r.source): r for r in mixing.reached_shares(drawn, targets).collect()}
    assert shares[("p", "big")].target_share == pytest.approx(0.6) and shares[("p", "big")].reached_share == pytest.approx(0.6, abs=0.02)
    assert shares[("p", "small")].most_copies <= 4 and shares[("p", "big")].most_copies <= 1
    assert shares[("q", "gone")].texts == 0 and shares[("q", "big")].reached_share == 1.0 and shares[("q", "big")].texts == 900
    assert drawn.groupBy("plan_id", "doc_id").count().where("count > 1").count() == 0
    assert mixing.draw(d.limit(0), plans, Q.VOCABULARY)[0].count() == 0 and mixing.draw(d, plans.limit(0), Q.VOCABULARY)[0].count() == 0


def test_a_given_total_is_filled_by_the_others(spark):
    stock = spark.createDataFrame([("a", 100, 10), ("b", 1000, 10), ("c", 1000, 10)], "source string, stock_tokens long, stock_texts long")
    plans = spark.createDataFrame([("p", "a", 0.5, 1), ("p", "b", 0.25, None), ("p", "c", 0.25, 2), ("q", "a", 1.0, 2)], "plan_id string, source string, target_share double, max_repeats int")
    got = {(r.plan_id, r.source): r.copies * r.stock_tokens for r in mixing.plan_targets(plans, stock, 900.0).collect()}
    assert got[("p", "a")] == pytest.approx(100) and got[("p", "b")] == pytest.approx(400) and got[("p", "c")] == pytest.approx(400)
    assert got[("q", "a")] == pytest.approx(200)  # all that its cap allows
    big = {(r.plan_id, r.source): r.copies * r.stock_tokens for r in mixing.plan_targets(plans, stock, 10_000.0).collect()}
    assert big[("p", "c")] == pytest.approx(2000) and big[("p", "b")] == pytest.approx(7900)


# ---------------------------------------------------------------- 10


def test_copies_of_a_text_are_not_compared(spark):
    n = 100_000
    base = "the quick brown fox jumps over the lazy dog and then some more words"
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(base).alias("text")).unionByName(spark.createDataFrame([(n, base.replace("o", "о"))], "doc_id long, text string"))
    pairs = visual_form.look_alike_pairs(df)
    assert pairs.count() == n and pairs.where(f"doc_b != {n}").count() == 0


def test_skeletons():
    same = [("pаypаl", "paypal"), ("Ｆｕｌｌ", "Full"), ("e\u0301t\u00e9", "\u00e9t\u00e9"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u2009c\u3000d", "a b c d"), ("𝐛old", "bold"), ("Αθ", "Aθ"), ("ё", "е\u0308")]
    for a, b in same:
        assert visual_form.skeleton(a) == visual_form.skeleton(b), (a, b)
    # one code point of each script: Greek, Cherokee, Lisu, Coptic, Armenian, numerals, small forms
    for a, b in zip("αιρυτκ" + "Ꭺ" + "ꓐ" + "Ⲟ" + "օ" + "Ⅰⅼ" + "ᴏ", "aiputk" + "A" + "B" + "O" + "o" + "Il" + "o"):
        assert visual_form.skeleton(a) == b, (a, b)
    for a, b in [("role", "rôle"), ("Role", "role"), ("l1", "11"), ("O0", "00"), ("x²", "x2"), ("a  b", "a b"), ("ß", "ss"), ("ﬁ", "fi")]:
        assert visual_form.skeleton(a) != visual_form.skeleton(b), (a, b)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_skeleton_is_stable(text):
    once = visual_form.skeleton(text)
    assert visual_form.skeleton(once) == once


def test_pairs_of_look_alikes(spark):
    base = "the quick brown fox jumps over the lazy dog and then some more words"
    rows = [(1, base), (2, base.replace("o", "о")), (3, base), (4, base.upper()), (5, "short"), (6, "ѕhort"), (7, None), (8, ""), (None, base), (9, base + "\u200b"), (2, base.replace("o", "о"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, skeleton string, n int")
    want = {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    for block in (1, 4096):
        got = [(r.doc_a, r.doc_b) for r in visual_form.look_alike_pairs(df, block=block, floor=block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert visual_form.look_alike_pairs(df.limit(0)).count() == 0
    forms = {r.doc_id: (r.form_id, r.members, r.spellings) for r in visual_form.form_classes(df).collect()}
    assert forms[9] == (1, 4, 3) and forms[4] == (4, 1, 1) and forms[6] == (5, 2, 2) and 7 not in forms
    assert visual_form.with_skeleton(df).where("doc_id = 7").first().skeleton is None
