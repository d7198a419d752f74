"""Decontamination: scripts without spaces, the roads for many words and shared windows, generated copies."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import contamination

FILLER = "some ordinary prose that nobody has ever put in a test and that goes on for a while. "
ITEM, TEXT = "item_id bigint, text string", "doc_id bigint, text string"
COLUMNS = ["doc_id", "item_id", "covered", "item_tokens", "slots", "changed"]


def rows(found):
    return sorted(map(tuple, found.select(*COLUMNS).collect()), key=str)


def test_scripts_without_spaces(spark):
    """Letters are words: whole copies, edited ones and short items; two letters weigh as one word."""
    items = [(1, "一个农民有十二只羊和五头牛，他卖掉了三只羊。请问他现在一共有多少只动物？"),
             (2, "ถ้ารถไฟออกจากสถานีเวลาแปดโมงเช้าและวิ่งด้วยความเร็วคงที่จะถึงปลายทางเมื่อใด"),
             (3, "次の文章を読んで、主人公がなぜ町を出たのかを説明しなさい。"), (4, "天空是"), (5, "水的沸点")]
    docs = [(k, FILLER + "在这里" + text + "结束" + FILLER) for k, text in items]
    docs += [(11, "问题：" + items[0][1].replace("卖掉了", "已经卖掉")), (12, "今天天气很好，我们一起去公园散步，然后回家吃饭。"),
             (13, FILLER), (14, items[2][1][:9])]
    found = contamination.find_items(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, ITEM))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 3), (11, 1)}
    longer = contamination.TemplateRules(shortest=2)
    found = contamination.find_items(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, ITEM), longer)
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(4, 4), (5, 5)}


NAMES = "Maria Peter Olga Ravi Chen Fatima Lukas Ingrid Diego Amara".split()
UNITS = "kg lb km miles hours minutes litres gallons euros dollars".split()


def with_values(text, rng):
    """The text with a number and unit, or a name, after every fifth word."""
    words, out = text.split(), []
    for k, word in enumerate(words):
        out.append(word)
        if k % 5 == 4:
            out += [str(rng.randint(2, 999)), rng.choice(UNITS)] if rng.random() < 0.6 else [rng.choice(NAMES)]
    return " ".join(out)


def swapped(text, rng):
    """Every number, name and unit replaced, the same one always by the same other one."""
    others = rng.sample(range(1000, 9999), 400)
    numbers = {n: str(others[k]) for k, n in enumerate(sorted(set(re.findall(r"\d+", text))))}
    names, units = (dict(zip(v, v[3:] + v[:3])) for v in (NAMES, UNITS))
    return re.sub(r"\w+", lambda m: {**numbers, **names, **units}.get(m[0], m[0]), text)


def test_generated_copies(spark, sf_dir):
    """Of the whole benchmark with all values replaced; texts with values that disagree, or other words, are no copies."""
    rng = random.Random(8)
    benchmark = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/benchmark.parquet").collect()
    items = [(r.item_id, with_values(r.text, rng)) for r in benchmark if len(r.text.split()) >= 8]
    docs = [(i, f"{FILLER}\n{swapped(text, rng)}\n{FILLER}") for i, text in items]
    others = [(10_000 + i, FILLER + " ".join(rng.sample(text.split(), len(text.split())))) for i, text in items]
    found = contamination.find_items(spark.createDataFrame(docs + others, TEXT), spark.createDataFrame(items, ITEM))
    found = {(r.doc_id, r.item_id): r for r in found.collect()}
    planted = {(i, i) for i, _ in items}
    assert len(items) >= 30 and len(planted & set(found)) >= 0.9 * len(planted)
    assert not set(found) - planted
    assert all(found[k].changed > 0 for k in planted & set(found))


STEM = "which of the following statements about the old town is true and why do you think so "
PLAIN = "amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean quarry ridge shore".split()


@pytest.fixture(scope="module")
def stems(spark):
    """Items behind a common question stem, some little more than it, and documents with items, stems and both."""
    rng = random.Random(4)
    items = [(k, STEM + " ".join(rng.sample(PLAIN, 1 + k % 18)) + f" on day {k}") for k in range(40)]
    items += [(50, STEM), (51, STEM.upper()), (52, STEM + "Boats are here")]
    docs = [(k, FILLER + text) for k, text in items] + [(100 + k, FILLER + STEM) for k in range(30)]
    docs += [(200 + k, (STEM + text[len(STEM):].title() + ". ") * 3) for k, text in items[:20]]
    docs += [(300, "Boats " + FILLER + STEM), (301, FILLER), (301, None), (None, items[9][1])] + [(400, items[20][1])] * 3
    return spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, ITEM)


def test_shared_windows(stems):
    """Deferring the widely shared windows loses no row, and fewer windows meet a document at first."""
    whole = rows(contamination.find_items(*stems, shared_by=10**9))
    assert len(whole) > 150
    for shared_by in (0, 1, 5, 30):
        assert rows(contamination.find_items(*stems, shared_by=shared_by)) == whole


def test_deferred_windows_make_no_copy(spark, stems):
    """The words under deferred windows are fewer than a copy needs; a stem by itself defers none of its own."""
    rules = contamination.TemplateRules()
    texts = stems[1].select(F.col("item_id").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(contamination.NO_NAMES)
    windows = texts.mapInArrow(
        contamination._item_rows(rules, common),
        "item_id bigint, template string, item_tokens bigint, size int, literal string, item_at bigint, hash bigint, "
        "item_slots array<string>").where("literal = ''")
    held = windows.groupBy("size", "hash").agg(F.count_distinct("template").alias("held")).where("held > 2")
    under, total = {}, {}
    for r in contamination._deferred(windows, held, rules).where("later").collect():
        under.setdefault(r.template, set()).update(range(r.item_at, r.item_at + r["size"]))
        total[r.template] = r.item_tokens
    assert under and all(len(under[t]) < rules.enough(total[t]) for t in under)


def test_words_by_join(spark, stems, odd_docs, no_docs):
    """Too many words of items for a dictionary: the same rows; also odd and empty tables."""
    joined = rows(contamination.find_items(*stems, shipped_words=0, shipped_windows=0, shared_by=1))
    assert joined == rows(contamination.find_items(*stems))
    items = stems[1].unionByName(odd_docs.where("length(text) < 1000 or text is null").select(
        F.col("doc_id").alias("item_id"), "text"))
    assert rows(contamination.find_items(odd_docs, items, shipped_words=0, shared_by=0)) == rows(
        contamination.find_items(odd_docs, items))
    assert contamination.find_items(no_docs, items, shipped_words=0, shared_by=0).count() == 0
    assert contamination.find_items(odd_docs, items.where("false"), shipped_words=0, shared_by=0).count() == 0


def test_words_by_join_without_broadcast(stems, setting):
    whole = rows(contamination.find_items(*stems))
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert rows(contamination.find_items(*stems, shipped_words=0, shared_by=1)) == whole
