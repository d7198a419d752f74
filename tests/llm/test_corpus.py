"""Quality rules, resharding, decontamination, conversations and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from itertools import product

import compare
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from clickloom.llm import contamination, conversations, quality, queries, resharding


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    names, expected = compare.sql_rows(compare.connect(sf_dir), queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names) and compare.spark_rows(df) == expected


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = ["a", "b", "c.", "d|", "#", "\n", "\n\n", " ", "\t", "home", "x y z w v u.", "We use cookies", "é😀"]
    made = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en") for i in range(150)]
    docs = odd_docs.where("doc_id is not null and doc_id <> 2").select("doc_id", "text", "lang").union(
        spark.createDataFrame(made, "doc_id bigint, text string, lang string"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names, expected = compare.sql_rows(con, quality.quality_sql())
    df = quality.quality_digest(quality.judge(docs))
    assert compare.spark_rows(df) == expected and sorted(df.columns) == sorted(names)
    assert quality.judge(odd_docs).count() == odd_docs.count()
    assert quality.clean_documents(no_docs).count() == 0 and quality.clean_documents(odd_docs).columns == odd_docs.columns


def test_flow_moves_the_fewest_bytes():
    for supplies, capacities in ((((5, 0, 3)), (2, 2, 4)), ((4, 4), (3, 3, 2)), ((0, 7), (7, 0))):
        n, m = len(supplies), len(capacities)
        costs = [[0 if i == j else 1 + (i * j) % 3 for j in range(m)] for i in range(n)]
        flow = resharding.min_cost_flow(supplies, capacities, costs)
        assert [sum(row) for row in flow] == list(supplies)
        assert all(sum(flow[i][j] for i in range(n)) <= capacities[j] for j in range(m))
        rows = [[r for r in product(range(s + 1), repeat=m) if sum(r) == s] for s in supplies]
        best = min(sum(costs[i][j] * way[i][j] for i in range(n) for j in range(m)) for way in product(*rows)
                   if all(sum(w[j] for w in way) <= capacities[j] for j in range(m)))
        assert sum(costs[i][j] * flow[i][j] for i in range(n) for j in range(m)) == best


def test_resharding_query(spark, sf_dir, texts):
    rows, by = queries.queries()["op6_resharding"](spark, sf_dir).collect(), defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    sizes = [sum(r.size for r in by[s]) for s in range(40)]
    assert all(sorted(r.slot for r in by[s]) == list(range(len(by[s]))) for s in range(40))
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_resharding_moves_little(spark):
    docs = spark.createDataFrame([(i, "x" * (84 + i % 5)) for i in range(4000)], "doc_id bigint, text string")
    assigned = resharding.reshard(docs, F.pmod("doc_id", F.lit(4)), 5).cache()
    sizes = {r["shard"]: r["b"] for r in assigned.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    total = sum(sizes.values())
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) < 500
    moved = assigned.where("old <> shard").agg(F.sum("size")).first()[0]
    assert abs(moved - total / 5) < 2000  # exactly what the new shard needs
    kept = resharding.reshard(docs, F.pmod("doc_id", F.lit(4)), 5, [10**6, 10**6, 10**6, 10**6, 0])
    assert kept.where("old <> shard").count() == 0
    assert resharding.changed_shards(resharding.transfers({0: 10, 1: 4}, 3, [6, 4, 4])) == [0, 2]
    written = resharding.rewrite(assigned, affected=[0, 4])
    assert sorted(written.select("doc_id", "text").collect()) == sorted(docs.collect())


def test_resharding_without_old_shards(spark):
    """New documents fill up the shards; those that had a place keep it where they fit."""
    docs = spark.createDataFrame([(i if i % 7 else None, "x" * (i % 50)) for i in range(600)], "doc_id bigint, text string")
    for old in (F.when(F.col("doc_id") % 2 == 0, F.lit(1)), F.lit(None).cast("int")):
        rows = resharding.reshard(docs, old, 3).select("shard", "size", "old", "doc_id").collect()
        assert len(rows) == 600 and {r.shard for r in rows} == {0, 1, 2}
        sizes = [sum(r.size for r in rows if r.shard == k) for k in range(3)]
        assert max(sizes) - min(sizes) < 200
        assert all(r.old == 3 for r in rows if r.doc_id is None or r.doc_id % 2)


def test_resharding_odd_rows(odd_docs, no_docs):
    rows = resharding.slots_digest(resharding.rewrite(resharding.reshard(odd_docs, F.lit(0), 3))).collect()
    assert len(rows) == odd_docs.count() and sum(r.size == 16 for r in rows) == 3
    assert resharding.slots_digest(resharding.rewrite(resharding.reshard(no_docs, F.lit(0), 3))).count() == 0


ITEMS = [(1, "Alice has 5 apples and gives Bob 3 kg of them. How many apples does Alice have left?"),
         (2, "The river runs past seven old mills before it meets the wide northern sea at dawn"),
         (3, "too short"), (4, None), (None, "An item that has no number at all but several plain words")]
FILLER = "some ordinary prose that nobody has ever put in a test and that goes on for a while. "


@pytest.mark.parametrize("shipped", [contamination.SHIPPED_WINDOWS, 0])
def test_items_in_documents(spark, shipped):
    docs = [(10, FILLER + ITEMS[0][1] + " " + FILLER, 0), (11, FILLER + ITEMS[1][1].upper(), 0),
            (12, FILLER + "alice has 12 apples and gives Carol 7 lb of them. How many apples does alice have left?", 0),
            (13, "Alice has 5 apples and gives Bob 3 kg of them. How many apples does Carol have left?", 0),
            (14, FILLER * 20, 0), (15, None, 0), (16, "", 0), (17, ITEMS[2][1], 0), (None, ITEMS[1][1], 0),
            (18, FILLER + ITEMS[1][1], 0), (18, FILLER + ITEMS[1][1], 0), (19, "The river runs past seven old", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in contamination.find_items(df, items, shipped_windows=shipped).collect()}
    assert {k for k in found if k[0] not in (11, 13)} == {(10, 1), (12, 1), (None, 2), (18, 2)}
    assert found[10, 1].changed == 0 and found[12, 1].changed >= 3
    assert contamination.find_items(df, items.where("false")).count() == 0
    assert contamination.find_items(df.where("false"), items).count() == 0
    left = contamination.without_items(df, items)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} >= {14, 15, 16, 17, 19, None} and 18 not in {r.doc_id for r in left.collect()}


def test_values_must_agree(spark):
    """The same windows with one value standing for two are no copy of the question."""
    item = "Give 4 pens to the first pupil and then give 9 pens to the second pupil and count all the pens"
    same = item.replace("4", "17").replace("9", "23")
    mixed = item.replace("4", "17").replace("9", "17")
    docs = spark.createDataFrame([(1, item), (2, same), (3, mixed)], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.changed) for r in contamination.find_items(docs, items).collect()} == {(1, 0), (2, 2)}


WORDS = ("amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge "
         "shore tower upland valley woods xylem yarrow zenith acorn birch clover daisy elder ferns gorse hazel iris "
         "jasmine kelp lilac").split()


def test_edited_copies(spark):
    """Words left out, put in or replaced; short items too. Half of the words in other order are no copy."""
    short = WORDS[:15]
    copies = {1: WORDS[:19] + WORDS[20:], 2: WORDS[:12] + WORDS[13:25] + WORDS[26:], 3: WORDS[:19] + ["new"] + WORDS[19:],
              4: [*WORDS[:12], "one", "more", *WORDS[12:25], "again", *WORDS[25:]], 5: WORDS[:10]}
    docs = [(k, FILLER + " ".join(w) + ". " + FILLER) for k, w in copies.items()]
    docs += [(6, FILLER + " ".join([*short[:7], "new", *short[8:]])), (7, " ".join(short[::-1])), (8, FILLER)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole, part = [(1, " ".join(WORDS))], [(2, " ".join(short))]
    found = [{r.doc_id: r.covered for r in contamination.find_items(
        df, spark.createDataFrame(i, "item_id bigint, text string")).collect()} for i in (whole, part)]
    assert found[0] == {1: 37, 2: 36, 3: 38, 4: 38}
    assert set(found[1]) == {1, 2, 3, 4, 5, 6} and found[1][6] == 14


@pytest.mark.parametrize("shipped", [contamination.SHIPPED_WINDOWS, 0])
def test_literal_copies(spark, shipped):
    """Few plain words, few words, headings and capitals on either side; equal templates by their own text."""
    items = [(1, "What is 345 plus 678?"), (2, "12 + 7 = 19, 8 + 5 = 13"), (3, "What is 2+2?"),
             (4, "The Rise And Fall Of The Northern Copper Kingdom"), (5, ITEMS[1][1]), (6, "What is 12 plus 34?"),
             (7, "SEVEN OLD WOMEN CARRY GREEN BASKETS UPHILL")]
    docs = [(10 + k, FILLER + text + " " + FILLER) for k, text in items]
    docs += [(24, FILLER + items[3][1].lower()), (25, FILLER + items[4][1].upper()), (35, FILLER + items[4][1].title()),
             (27, "They saw seven old women carry green baskets uphill."), (40, "What is 999 plus 1?"), (41, FILLER)]
    found = contamination.find_items(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                     spark.createDataFrame(items, "item_id bigint, text string"), shipped_windows=shipped)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {
        *((10 + k, k) for k, _ in items), (24, 4), (25, 5), (35, 5), (27, 7)}


def test_names_and_values(spark):
    """Names that open sentences; one of two equal numbers edited; two numbers that became one."""
    line = " ".join(WORDS[:14])
    items = {1: "Maria works 8 hours. Tom works 6 hours. Ann works 7 hours. Who earns the most?",
             2: f"{line} then 5 plates and the same cook then sold 5 plates to {' '.join(WORDS[20:30])}",
             3: "The baker sold 2 apples and 3 pears to 9 guests of the old harbour inn before noon. How much was left?"}
    docs = [(1, items[1].replace("Maria", "Peter").replace("Tom", "Olga").replace("Ann", "Ravi")),
            (2, items[2].replace("sold 5", "sold 6")),
            (3, items[3].replace("2 ", "4 ").replace("3 ", "4 ").replace("9 ", "11 ")),
            (4, items[3].replace("2 ", "3 ")), (5, "Olga works 8 hours. Then she goes home and reads."), (6, FILLER)]
    df = spark.createDataFrame([(k, FILLER + text + " " + FILLER) for k, text in docs], "doc_id bigint, text string")
    found = contamination.find_items(df, spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    changed = {(r.doc_id, r.item_id): r.changed for r in found.collect()}
    assert changed == {(1, 1): 1, (2, 2): 0, (3, 3): 1, (4, 3): 0}  # changed values of the matched part


def test_benchmark_passages(spark, sf_dir, texts):
    def plain(text):
        return " ".join(re.findall(r"\w+", text.lower()))

    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.queries()["op8_decontamination"](spark, sf_dir).collect()}
    assert found == {(d, i) for d, t in texts.items() for i, x in items.items() if x in plain(t)}


def rendered(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_snapshots_collapse(spark):
    rng, logged = random.Random(3), {}
    for conv in range(120):
        logged[conv] = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 7))]
    logged[500] = [("user", str(k)) for k in range(700)]
    logged[501] = logged[500][:650]
    rows = [(c, k * 3, r, t, 0) for c, turns in logged.items() for k, (r, t) in enumerate(turns)]
    rows += rows[:50] + [(None, 0, "user", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk int")
    by = defaultdict(dict)
    for r in conversations.render_maximal(df).collect():
        by[r.conv_id][r.chunk] = r
    expected = {}
    for conv, turns in logged.items():
        longer = any(len(o) > len(turns) and o[:len(turns)] == turns for o in logged.values())
        equal = [c for c, o in logged.items() if o == turns]
        if not longer and conv == min(equal):
            expected[conv] = (len(turns), len(equal), rendered(turns))
    assert {c: (v[0].n_turns, v[0].copies, "".join(v[k].text for k in sorted(v))) for c, v in by.items()} == expected
    assert len(by[500]) == 3


def test_odd_conversations(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 0, "user", ""), (2, 0, "user", "x"),
                                (3, 0, "user", "<|im_end|>")], "conv_id bigint, turn bigint, role string, text string")
    texts = {r.conv_id: r.text for r in conversations.render_maximal(df).collect()}
    assert texts == {2: rendered([("user", ""), ("user", "x")]), 3: rendered([("user", "<| im_end |>")])}
    assert conversations.render_maximal(df.where("false")).count() == 0


def test_no_python_in_native_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = quality.quality_digest(quality.judge(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_pipeline_by_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
        assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    judged = {r.doc_id for r in queries.queries()["op10_quality_rules"](spark, sf_dir).where("kept").collect()}
    assert ids[1] == judged and ids[1] >= ids[2] >= ids[3] == ids[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)
    assert {r.doc_id for r in packed.collect()} == ids[4]
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()))
    assert whole == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        docs = docs.withColumn("n_chars", F.lit(0).cast("bigint"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()
