"""Benchmark items in documents, also with other numbers, names and units.

Texts become templates: numbers, names and units are replaced by typed placeholders. Windows of template words are
joined by hash. Matching windows of a document and an item on neighbouring lines (document position less item position)
belong together, so that words put in or left out do not split a copy. One value of the item is one value in the
document, and the other way round; windows whose placeholders say otherwise are left out. An item is in a document when
enough of its words are covered.

Literal windows, of lower-case words and numbers as they stand, are joined beside them: for items of few plain words, of
few words at all, and for copies in other capitals. In scripts without spaces every letter counts as a word.

A window that very many templates hold (a question stem) would meet all its documents with all its items. So each template
defers its most widely shared windows, as long as they cover fewer words than a copy needs: every copy then matches one of
the others, and the deferred ones are fetched only for the pairs of document and template that are already met.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.plans.lookup import lookup_join
from clickloom.plans.workspace import staged

# Units, and numbers in words.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb "
                  "lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute "
                  "minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro "
                  "euros usd eur gbp percent degree degrees c f k w kw kwh v a ma hz khz mhz ghz kb mb gb tb mph kmh".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                         "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                         "hundred thousand million billion".split())
_BREAKS = frozenset(".!?:\n。！？：")
# Thai and Lao, Myanmar, Khmer, Hiragana and Katakana, and Han, which put no spaces between words.
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
# Words that are no names although they open sentences.
NO_NAMES = frozenset("a an the this that these those some any all each every no one both many most more few several and or "
                     "but if so then when while as at by for from in into of on to with without after before since until "
                     "i you he she it we they his her its our your their my who whom whose what which where why how is "
                     "are was were be do does did has have had can could will would shall should may might must not there "
                     "here let find give given calculate suppose assume consider determine compute show prove solve "
                     "write explain choose select".split())
_TOKEN = re.compile(rf"[^\W\d_{_SPACELESS}]+|\d+(?:[.,]\d+)*|[.!?:\n。！？：]|(?![\W\d_])[{_SPACELESS}]")
_LETTER = re.compile(f"[{_SPACELESS}]")
_NUMBER, _NAME, _UNIT = "\x01number", "\x01name", "\x01unit"
_SLOTS = (_NUMBER, _NAME, _UNIT)
# Flags of a token beside the number of its word among the known ones.
_WORD_BITS = 40
_IS_BREAK, _IS_NUMBER, _IS_CAPITAL, _IS_UNIT, _IS_SEEN, _IS_LETTERS, _IS_COMMON, _IS_END = (
    1 << _WORD_BITS + k for k in range(8))
# Seeds of the hashes of template windows and of literal ones.
_TEMPLATE, _LITERAL = 0, 1
_MEMORY = 500_000
# Texts of about so many characters are read together.
_TOGETHER = 1_000_000
# Items with up to so many windows reach the tasks as a filter; beyond it every window is joined.
SHIPPED_WINDOWS = 2_000_000
# Up to so many words of items reach the tasks as a dictionary; beyond it documents get theirs by a join.
SHIPPED_WORDS = 500_000
# Windows in more templates than this are deferred where that loses no copy.
SHARED_BY = 64


@dataclass(frozen=True)
class TemplateRules:
    """``window`` words per window, and a third of shorter items down to ``least``; ``plain`` of them no placeholders.

    An item counts as present when at least ``percent`` of its words are covered, and no fewer than ``window`` words or
    two thirds of it. Lines of one copy are up to an item's length over ``drift`` apart. Items of ``shortest`` words, but
    fewer than ``least``, count only as they stand. Two letters of a script without spaces weigh as one word there.
    """

    window: int = 8
    least: int = 5
    shortest: int = 3
    plain: int = 4
    percent: int = 50
    drift: int = 4

    def sizes(self, words: int) -> list[int]:
        """The short one for edited copies; the long one has enough plain words more often."""
        return sorted({min(words, max(self.least, min(self.window, words // 3))), min(words, self.window)})

    def enough(self, words: int) -> int:
        if words < self.least:
            return words
        return max(-(-words * self.percent // 100), min(self.window, -(-words * 2 // 3)))

    def enough_of(self, words: Column) -> Column:
        share, two_thirds = F.ceil(words * self.percent / 100), F.ceil(words * 2 / 3)
        return F.when(words < self.least, words).otherwise(F.greatest(share, F.least(F.lit(self.window), two_thirds)))


def _code(token: str, low: str) -> int:
    """Flags of a token, without its word."""
    capital = _IS_CAPITAL if token[0] != low[0] else 0
    if low in UNITS:
        return _IS_UNIT | _IS_LETTERS | capital
    if token[0].isalpha():
        return _IS_LETTERS | (_IS_NUMBER if low in NUMBER_WORDS else capital)
    return _IS_NUMBER if token[0].isdigit() else _IS_BREAK


def word_number(low: str) -> int:
    return xxhash.xxh64_intdigest(low.encode()) >> 64 - _WORD_BITS or 1


class Templates:
    """Words of texts as numbers. ``words`` limits them to known ones: others get 0.

    A capital word inside a sentence is a name. At the start of one, and where most words of a sentence have capitals
    (headings, shouting), the ``common`` words are none.
    """

    def __init__(self, common: frozenset[str], words: dict[str, int] | None = None):
        self.common = common
        self.words = words
        self.codes: dict[str, int] = {"": _IS_END}
        self.sizes: list[int] = []  # tokens of each text that was read last, with its end

    def _learn(self, token: str) -> int:
        low = token.lower()
        value = _value(token)
        if self.words is None:
            word = word_number(value)
        else:
            word = self.words.get(value, 0)
        code = _code(token, low) | word | _IS_SEEN | (_IS_COMMON if low in self.common else 0)  # never 0
        if len(self.codes) < _MEMORY:
            self.codes[token] = code
        return code

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Numbers of the template words (placeholders are 1 to 3 in the bits above the words) and of the literal words,
        where their tokens are, and the tokens. Every text ends with an empty token and the number 0, as of an unknown
        word."""
        tokens: list[str] = []
        self.sizes = []
        for text in texts:
            found = _TOKEN.findall(text)
            tokens += found
            tokens.append("")
            self.sizes.append(len(found) + 1)
        known, learn = self.codes.get, self._learn
        codes = np.array([known(t) or learn(t) for t in tokens], dtype=np.int64)
        breaks = codes & (_IS_BREAK | _IS_END) != 0
        starts = np.concatenate([[True], breaks[:-1]])
        real = np.flatnonzero(codes & _IS_BREAK == 0)
        sentence = np.cumsum(breaks)[real]
        codes, starts = codes[real], starts[real]
        number, capital = codes & _IS_NUMBER != 0, codes & _IS_CAPITAL != 0
        loud = (2 * np.bincount(sentence, capital) > np.bincount(sentence, codes & _IS_LETTERS != 0))[sentence]
        name = capital & ~number & np.where(loud | starts, codes & _IS_COMMON == 0, True)
        unit = (codes & _IS_UNIT != 0) & ~name & np.concatenate([[False], number[:-1]])
        literal = codes & (1 << _WORD_BITS) - 1
        out = literal.copy()
        for k, mask in enumerate((number, name, unit), 1):
            out[mask] = k << _WORD_BITS
        return out, literal, real, tokens


def together(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts, in order."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= _TOGETHER:
            yield own
            own, size = [], 0
    if own:
        yield own


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def window_hashes(words: np.ndarray, sizes: list[int], plain: int,
                  seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, positions and hashes of the windows that count: no unknown word and enough plain ones. Sizes ascend."""
    mixed = _mixed(words)
    unknown = np.concatenate([[0], np.cumsum(words == 0)])
    slots = np.concatenate([[0], np.cumsum(words >> _WORD_BITS > 0)])
    places, hashes, done = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64), 0
    for size in sizes:
        whole = places[:np.searchsorted(places, len(words) - size, side="right")]
        whole = np.flatnonzero(unknown[whole + size] == unknown[whole])
        places, hashes = places[whole], hashes[whole]
        for k in range(done, size if len(places) else done):
            hashes = hashes * np.uint64(0x100000001B3) + mixed[places + k]
        done = size
        counted = size - (slots[places + size] - slots[places]) >= plain
        yield size, places[counted], _mixed(hashes[counted] + np.uint64(size + (seed << 32))).view(np.int64)


def _value(token: str) -> str:
    return token.lower().replace(",", "")


def _slots(words: np.ndarray, real: np.ndarray, tokens: list[str], start: int, size: int) -> list[str]:
    """``offset type value`` of the placeholders in a window."""
    return [f"{k} {words[start + k] >> _WORD_BITS} {_value(tokens[real[start + k]])}"
            for k in range(size) if words[start + k] >> _WORD_BITS]


def _no_names(batch: pa.RecordBatch, common) -> frozenset[str]:
    """The common words: all of them where they are shipped, otherwise those that the texts at hand have in capitals."""
    if common is not None:
        return common.value
    return NO_NAMES.union(*(words or () for words in batch.column("common").to_pylist()))


def _item_rows(rules: TemplateRules, common) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(NO_NAMES)
        for batch in batches.slices(source):
            rows, templates.common = [], _no_names(batch, common)
            for item, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, literal, real, tokens = templates.read([text])
                words, literal = words[:-1], literal[:-1]
                if len(words) - sum(map(bool, map(_LETTER.match, tokens))) // 2 < rules.shortest:
                    continue
                exact = xxhash.xxh3_128_hexdigest(literal.tobytes())
                n, sizes, own = len(words), rules.sizes(len(words)), []
                for size, places, hashes in window_hashes(words, sizes if n >= rules.least else [], rules.plain, _TEMPLATE):
                    own += [(size, "", p, h, _slots(words, real, tokens, p, size))
                            for p, h in zip(places.tolist(), hashes.tolist(), strict=True)]
                # Without windows of its own, a template says nothing of the item.
                key = xxhash.xxh3_128_hexdigest(words.tobytes()) if own else f"literal {exact}"
                for size, places, hashes in window_hashes(literal, sizes[:1], 0, _LITERAL):
                    own += [(size, exact, p, h, []) for p, h in zip(places.tolist(), hashes.tolist(), strict=True)]
                rows += [(item, key, n, *w) for w in own]
            yield _batch(rows, {"item_id": pa.int64(), "template": pa.string(), "item_tokens": pa.int64(),
                                "size": pa.int32(), "literal": pa.string(), "item_at": pa.int64(), "hash": pa.int64(),
                                "item_slots": pa.list_(pa.string())})

    return run


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _item_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and numbers of items, and how often each is written small, and with a capital inside a sentence."""
    for batch in batches.slices(source):
        found, small, inside = set(), Counter(), Counter()
        for text in batch.column("text").to_pylist():
            tokens = _TOKEN.findall(text)
            found.update(map(_value, tokens))
            small.update(t for t in tokens if t[0].islower())
            inside.update(t.lower() for before, t in zip(tokens, tokens[1:]) if t[0].isupper() and before not in _BREAKS)
        yield _batch([(w, small[w], inside[w]) for w in found],
                     {"word": pa.string(), "small": pa.int64(), "inside": pa.int64()})


def _capital_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased words that the texts have with a capital, but for those that are never names."""
    for batch in batches.slices(source):
        rows = {(key, t.lower()) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(),
                                                      strict=True) for t in _TOKEN.findall(text) if t[0] != t[0].lower()}
        yield _batch([r for r in rows if r[1] not in NO_NAMES], {"key": pa.string(), "word": pa.string()})


def _with_common(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the common words that a text has in capitals, met by joins; equal texts are looked up once."""
    keyed = texts.withColumn("key", F.md5("text"))
    capitals = keyed.select("key", "text").mapInArrow(_capital_words, "key string, word string").distinct()
    known = lookup_join(capitals, words.where("common"), "word").where("common")
    return lookup_join(keyed, known.groupBy("key").agg(F.collect_list("word").alias("common")), "key",
                       ["doc_id", "text"]).drop("key")


def _doc_rows(rules: TemplateRules, sizes: dict[int, list[int]], common, filters) -> Callable:
    """Windows of documents: those in the filter, or all where there is none."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_known, wanted = filters.value if filters else (None, None)
        templates = Templates(NO_NAMES, words_known)
        row = TaskContext.get().partitionId() << 40
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "size": pa.int32(), "at": pa.int64(), "hash": pa.int64(),
                 "slots": pa.list_(pa.string())}
        for batch in batches.slices(source):
            rows, templates.common = [], _no_names(batch, common)
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in together(batch.column("text").to_pylist()):
                words, literal, real, tokens = templates.read(texts)
                ends = np.searchsorted(real, np.cumsum(templates.sizes) - 1)
                for seed, read, plain in ((_TEMPLATE, words, rules.plain), (_LITERAL, literal, 0)):
                    for size, places, own in window_hashes(read, sizes[seed], plain, seed):
                        if wanted is not None and len(own):
                            hashes = wanted[seed, size]
                            k = np.searchsorted(hashes, own)
                            hit = hashes[np.minimum(k, len(hashes) - 1)] == own
                            places, own = places[hit], own[hit]
                        of = np.searchsorted(ends, places)
                        begins = np.concatenate([[0], ends + 1])[of]
                        rows += [(row + at + d, ids[at + d], size, p - b, h, _slots(read, real, tokens, p, size))
                                 for d, b, p, h in zip(of.tolist(), begins.tolist(), places.tolist(), own.tolist(),
                                                       strict=True)]
                at += len(texts)
            row += at
            yield _batch(rows, kinds)

    return run


def _deferred(windows: DataFrame, held: DataFrame, rules: TemplateRules) -> DataFrame:
    """Adds ``later`` to the widely ``held`` windows that their template can do without.

    A word of a template is as frequent as the most frequent of such windows over it. The windows above the frequency
    that as many words as a copy needs reach cover fewer words than that, so they make no copy by themselves.
    """
    tagged = staged(windows.join(held, ["size", "hash"], "left"), "shared")
    places = tagged.where("held is not null").select(
        "template", "item_tokens", "held", F.explode(F.expr("sequence(item_at, item_at + size - 1)")).alias("place"))
    places = places.groupBy("template", "place").agg(F.max("held").alias("held"), F.first("item_tokens").alias("item_tokens"))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("held"), "place"))
    needed = places.withColumn("rank", rank).where(F.col("rank") == rules.enough_of(F.col("item_tokens"))).select(
        "template", F.col("held").alias("needed"))
    later = F.coalesce(F.col("held") > F.coalesce("needed", F.lit(0)), F.lit(False))
    return tagged.join(needed, "template", "left").withColumn("later", later).drop("held", "needed")


def _met(found: DataFrame, windows: DataFrame, rules: TemplateRules, shared_by: int) -> DataFrame:
    """Windows of documents with those of templates that have the same hash."""
    held = windows.groupBy("size", "hash", "template").agg(F.lit(1).alias("one")).groupBy("size", "hash").agg(
        F.count("one").alias("held")).where(F.col("held") > shared_by)
    held = staged(held, "held")
    if held.isEmpty():
        return found.join(windows, ["size", "hash"])
    windows = staged(_deferred(windows, held, rules), "deferred")
    found = staged(found, "windows")
    first = found.join(windows.where("not later").drop("later"), ["size", "hash"])
    asked = first.select("row", "template").distinct().join(windows.where("later").drop("later"), "template")
    return first.unionByName(found.join(asked, ["row", "size", "hash"]))


def find_items(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               shipped_windows: int = SHIPPED_WINDOWS, shipped_words: int = SHIPPED_WORDS,
               shared_by: int = SHARED_BY) -> DataFrame:
    """(``doc_id``, ``item_id``) for every item found, with ``covered`` and ``item_tokens``, ``slots`` and ``changed``.

    ``slots`` counts the different values behind placeholders of the matched part and ``changed`` those that are others
    in the document; 0 changed is a literal copy. Items with equal templates count as one, under their smallest id;
    without ids it is null. Windows that match literally count no values. Items of fewer than ``rules.shortest`` words,
    and null or empty texts on either side, match nothing. One row per document id and item, with its best-covered place; repeated rows agree in it.
    ``shipped_windows``, ``shipped_words`` and ``shared_by`` choose between roads to the same rows.
    """
    spark = docs.sparkSession
    texts, doc_texts = batches.texts(items, item_col, item_text_col), batches.texts(docs, id_col, text_col)
    words = staged(texts.mapInArrow(_item_words, "word string, small bigint, inside bigint").groupBy("word").agg(
        (F.sum("small") > F.sum("inside")).alias("common")), "words")
    common = numbers = None
    if words.count() <= shipped_words:
        known = words.toPandas()
        common = spark.sparkContext.broadcast(frozenset(known["word"][known["common"].astype(bool)]) | NO_NAMES)
        numbers = {w: word_number(w) for w in known["word"]}
    else:
        texts, doc_texts = _with_common(texts, words), _with_common(doc_texts, words)
    windows = staged(texts.mapInArrow(
        _item_rows(rules, common),
        "item_id bigint, template string, item_tokens bigint, size int, literal string, item_at bigint, hash bigint, "
        "item_slots array<string>"), "items")
    # Equal templates have equal windows, and differ in their values only: the smallest id stands for all.
    first = windows.groupBy("template", "literal", "size", "item_at").agg(F.min_by(
        F.struct("item_id", "item_tokens", "hash", "item_slots"),
        F.struct(F.col("item_id").isNull(), "item_id", "item_slots")).alias("one"))
    ids = windows.groupBy("template").agg(F.min("item_id").alias("item_id"))
    windows = staged(first.select("template", "literal", "size", "item_at", "one.*").drop("item_id").join(ids, "template"),
                     "templates")
    seed = F.when(F.col("literal") == "", _TEMPLATE).otherwise(_LITERAL).alias("seed")
    sizes = {_TEMPLATE: [], _LITERAL: []}
    for r in windows.select(seed, "size").distinct().orderBy("size").collect():  # at most rules.window of each
        sizes[r["seed"]].append(r["size"])
    filters = None
    if windows.count() <= shipped_windows:
        hashes = windows.select(seed, "size", "hash").distinct().toPandas()
        wanted = {k: np.sort(g["hash"].to_numpy(dtype=np.int64)) for k, g in hashes.groupby(["seed", "size"])}
        filters = spark.sparkContext.broadcast((numbers, wanted))
    found = doc_texts.mapInArrow(
        _doc_rows(rules, sizes, common, filters),
        "row bigint, doc_id bigint, size int, at bigint, hash bigint, slots array<string>")
    return _judged(_met(found, windows, rules, shared_by), rules)


Matched = tuple[int, int, int, list[str], list[str]]


def _judge(rules: TemplateRules, item_tokens: int, windows: list[Matched]) -> tuple[int, int, int] | None:
    """Covered words, values and changed values of matching windows (item and document place, size, both slots)."""
    on_line = Counter(at - item_at for item_at, at, *_ in windows)
    main = max(on_line, key=lambda line: (on_line[line], -line))
    nearest: dict[int, int] = {}  # one place in the document for each of the item
    for item_at, at, *_ in sorted(windows, key=lambda w: (-on_line[w[1] - w[0]], abs(w[1] - w[0] - main), w[1])):
        nearest.setdefault(item_at, at)
    kept = [w for w in windows if nearest[w[0]] == w[1]]
    values = _agreed(kept)
    if values is None:
        return None
    kept = [w for w in kept if values.issuperset(_values(w))]
    values = {pair for w in kept for pair in _values(w)}
    covered = min(len({at + k for at, size in {(w[side], w[2]) for w in kept} for k in range(size)}) for side in (0, 1))
    return None if covered < rules.enough(item_tokens) else (covered, len(values), sum(i != d for i, d in values))


def _agreed(windows: list[Matched]) -> set[tuple[str, str]] | None:
    """Pairs of values, each value once: the most frequent pair of an item value, and unchanged ones before others.

    None where nothing but other values for one another remains: several values turned into one are no copy.
    """
    places = {(w[0] + int(slot.split(" ", 1)[0]), pair)
              for w in windows for slot, pair in zip(w[3], _values(w), strict=True)}
    votes = Counter(pair for _, pair in places)
    chosen: dict[str, str] = {}
    for item, doc in sorted(votes, key=lambda p: (-votes[p], p[0] != p[1], p)):
        chosen.setdefault(item, doc)
    shared = Counter(chosen.values())
    agreed = {(i, d) for i, d in chosen.items() if shared[d] == 1 or i == d}
    return agreed if agreed or not votes else None


def _values(window: Matched) -> list[tuple[str, str]]:
    """Type and value of the placeholders in the item, and in the document."""
    return [(i.split(" ", 1)[1], d.split(" ", 1)[1]) for i, d in zip(window[3], window[4], strict=True)]


_JUDGED = {"doc_id": pa.int64(), "template": pa.string(), "item_id": pa.int64(), "item_tokens": pa.int64(),
           "covered": pa.int64(), "slots": pa.int64(), "changed": pa.int64()}


def _judge_rows(rules: TemplateRules) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(source):
            rows = []
            for r in batch.to_pylist():
                found = _judge(rules, r["item_tokens"], [tuple(w.values()) for w in r["windows"]])
                rows += [(r["doc_id"], r["template"], r["item_id"], r["item_tokens"], *found)] if found else []
            yield _batch(rows, _JUDGED)

    return run


def _judged(pairs: DataFrame, rules: TemplateRules) -> DataFrame:
    """Groups of matching windows on neighbouring lines of one document and item; their size is bounded by the item's.

    Every line is in two bands of lines, so that lines no further apart than the drift share one.
    """
    band = F.floor((F.col("at") - F.col("item_at")) / F.greatest(F.lit(2), F.floor(F.col("item_tokens") / rules.drift)))
    groups = pairs.withColumn("band", F.explode(F.array(band, band - 1))).groupBy("row", "doc_id", "template", "band").agg(
        F.min("item_id").alias("item_id"), F.first("item_tokens").alias("item_tokens"),
        F.collect_set(F.struct("item_at", "at", "size", "item_slots", "slots")).alias("windows"))
    judged = groups.select("doc_id", "template", "item_id", "item_tokens", "windows").mapInArrow(
        _judge_rows(rules), ", ".join(f"{c} {'string' if c == 'template' else 'bigint'}" for c in _JUDGED))
    best = F.max_by(F.struct("item_id", "item_tokens", "covered", "slots", "changed"),
                    F.struct("covered", -F.col("changed"), -F.col("slots"))).alias("best")
    return judged.groupBy("doc_id", "template").agg(best).select("doc_id", "best.*")


def without_items(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), id_col: str = "doc_id",
                  **columns) -> DataFrame:
    """The documents in which no item was found, with all their columns. Rows without an id are kept."""
    found = find_items(docs, items, rules, id_col, **columns).where("doc_id is not null")
    hit = found.select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(hit, docs[id_col] == hit["_found"], "left_anti")
