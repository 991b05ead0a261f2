"""Training texts that hold items of a test set: BM25 with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.session import stored

K1, B = 1.2, 0.75
PASSAGE_WORDS, PASSAGE_STEP = 64, 32
ENTRY_WORDS = 48
TERM_WORDS = 2
THRESHOLD = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
GRAM = 3
POSTING_BLOCK = 64
INDEX_BYTES = 16 << 20
PART_BYTES = 8 << 20

_SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, word bigint"


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return tx.hash_words(data, np.array([0, len(data)]), tx.PUNCTUATION)[0]


def _terms(words: np.ndarray) -> np.ndarray:
    """The index terms of a run of words: its word pairs, which chance repeats far less than words."""
    return tx.shingles(words, np.zeros(len(words), np.int64), TERM_WORDS)[0]


def _entries(words: np.ndarray) -> list[np.ndarray]:
    """The terms of each entry of an item."""
    return [_terms(part) for part in np.array_split(words, max(1, -(-len(words) // ENTRY_WORDS)))]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: up to its last question mark and the rest, or all but the last sentence and that.

    All of it is the question where that would have less than ``GRAM`` words.
    """
    text = text.strip()
    at = text.rfind("?")
    # a question of less than a few words says nothing
    if 0 <= at < len(text) - 1:
        return (text[: at + 1], text[at + 1 :]) if len(_hashes(text[: at + 1])) >= GRAM else (text, "")
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends and len(_hashes(text[: ends[-1]])) >= GRAM else (text, "")


class _Cursor:
    """A place in the postings of one term."""

    __slots__ = ("at", "block_max", "bound", "entries", "impacts")

    def __init__(self, entries: list[int], impacts: list[float], block_max: list[float]) -> None:
        self.at, self.entries, self.impacts, self.block_max, self.bound = 0, entries, impacts, block_max, max(block_max)

    def block(self, entry: int) -> tuple[float, int]:
        """The greatest impact in the block that could hold an entry, and the last entry of that block."""
        at = bisect_left(self.entries, entry, self.at)
        if at == len(self.entries):
            return 0.0, 0
        number = at // POSTING_BLOCK
        return self.block_max[number], self.entries[min((number + 1) * POSTING_BLOCK, len(self.entries)) - 1]

    def skip(self, entry: int) -> None:
        self.at = bisect_left(self.entries, entry, self.at)


class Index:
    """An inverted index of item entries with block maxima; impacts are shares of an entry's score for itself.

    A long item has several entries of up to ``ENTRY_WORDS`` words, so that a passage can match each of them. ``whole``
    has the statistics of all test items, if these are only some of them: the number and the mean length of
    entries, all terms here in order, and the number of entries that hold each.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, np.ndarray, np.ndarray] | None = None) -> None:
        self.items, entries, self.item_of = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            question, answer = split_item(text)
            words = _hashes(text)
            if len(words) < GRAM:
                if len(words):
                    run = int(tx.shingles(words, np.zeros(len(words), np.int64), len(words))[0][0])
                    self.short.setdefault(len(words), {}).setdefault(run, []).append(item_id)
                continue
            q, a = _hashes(question), _hashes(answer)
            self.items.append((item_id, np.unique(tx.shingles(q, np.zeros(len(q), np.int64), GRAM)[0]), np.unique(a), len(words)))
            for entry in _entries(words):
                entries.append(entry)
                self.item_of.append(len(self.items) - 1)
        self.terms = np.unique(np.concatenate(entries)) if entries else np.zeros(0, np.uint64)
        n, mean = len(entries), max(1.0, float(np.mean([len(e) for e in entries])) if entries else 1.0)
        found = [np.unique(np.searchsorted(self.terms, e), return_counts=True) for e in entries]
        df = np.bincount(np.concatenate([t for t, _ in found]), minlength=len(self.terms)) if found else np.zeros(0)
        if whole is not None:
            n, mean, known, counts = whole
            df = counts[np.searchsorted(known, self.terms)]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        triples = []
        for number, (terms, tf) in enumerate(found):
            weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(entries[number]) / mean))
            triples.append((terms, np.full(len(terms), number), weight / weight.sum()))
        columns = [np.concatenate(c) for c in zip(*triples, strict=True)] if triples else [np.zeros(0)] * 3
        order = np.lexsort((columns[1], columns[0]))
        term, entry, impact = (c[order] for c in columns)
        starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.postings, self.bound = [], np.zeros(len(self.terms) + 1)
        # a pair outside the index has the last place, with no impact
        for t in range(len(self.terms)):
            entries, impacts = entry[starts[t] : starts[t + 1]].tolist(), impact[starts[t] : starts[t + 1]].tolist()
            self.postings.append((entries, impacts, [max(impacts[at : at + POSTING_BLOCK]) for at in range(0, len(impacts), POSTING_BLOCK)]))
            self.bound[t] = max(impacts)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The term number of the pair at each word, the number of terms where there is none or it is not in the index."""
        out = np.full(len(words), len(self.terms))
        if len(words) >= TERM_WORDS and len(self.terms):
            pairs = _terms(words)
            at = np.searchsorted(self.terms, pairs)
            at[at == len(self.terms)] = 0
            out[: len(pairs)] = np.where(self.terms[at] == pairs, at, len(self.terms))
        return out

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All entries whose score for the given different terms reaches the threshold, by block-max WAND."""
        lists, out = [_Cursor(*self.postings[t]) for t in terms], []
        # a little slack, so that no score is lost to the order of additions
        need = threshold - 1e-9
        while lists:
            lists.sort(key=lambda c: c.entries[c.at])
            total, pivot = 0.0, -1
            for number, cursor in enumerate(lists):
                total += cursor.bound
                if total >= need:
                    pivot = number
                    break
            if pivot < 0:
                break
            target = lists[pivot].entries[lists[pivot].at]
            while pivot + 1 < len(lists) and lists[pivot + 1].entries[lists[pivot + 1].at] == target:
                pivot += 1
            ahead, after = lists[: pivot + 1], target + 1
            blocks = [c.block(target) for c in ahead]
            if sum(most for most, _ in blocks) < need:
                # nothing up to the end of the shortest block can reach the threshold with these lists
                ends = [end for most, end in blocks if most]
                after = max(after, min(ends, default=target) + 1)
                if pivot + 1 < len(lists):
                    after = max(target + 1, min(after, lists[pivot + 1].entries[lists[pivot + 1].at]))
            elif lists[0].entries[lists[0].at] == target:
                score = sum(c.impacts[c.at] for c in ahead)
                if score >= need:
                    out.append((target, score))
            else:
                after = target
            for cursor in ahead:
                cursor.skip(after)
            lists = [c for c in lists if c.at < len(c.entries)]
        return out

    def _short_leaks(self, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple]:
        """The first place in each text of each item that is too short for the index: its whole word sequence."""
        starts = np.searchsorted(owner, np.arange(owner[-1] + 1))
        for size, items in self.short.items():
            whole = np.flatnonzero(owner[: len(words) - size + 1] == owner[size - 1 :])
            if not len(whole):
                continue
            runs = tx.shingles(words, np.arange(len(words)) // len(words), size)[0]
            at = whole[np.isin(runs[whole], np.array(list(items), np.uint64))]
            seen = set()
            for place in at.tolist():
                text, run = int(owner[place]), int(runs[place])
                if (text, run) not in seen:
                    seen.add((text, run))
                    for item_id in items[run]:
                        yield text, item_id, 1.0, 1.0, 1.0, place - int(starts[text])

    def leaks(self, words: np.ndarray, owner: np.ndarray, count: int) -> Iterator[tuple]:
        """Per text and item found in it: both numbers, the best score, both overlaps and the passage's first word."""
        if not len(words):
            return
        yield from self._short_leaks(words, owner)
        if not len(self.items):
            return
        cuts = np.searchsorted(owner, np.arange(count + 1))
        term = self.places(words)
        term[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = len(self.terms)
        sums = np.concatenate([[0.0], np.cumsum(self.bound[term])])
        size = np.diff(cuts)
        passages = np.where(size > 0, np.maximum(0, -(-(size - PASSAGE_WORDS) // PASSAGE_STEP)) + 1, 0)
        text = np.repeat(np.arange(count), passages)
        first = cuts[text] + PASSAGE_STEP * (np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages))
        last = np.minimum(first + PASSAGE_WORDS - TERM_WORDS + 1, cuts[text + 1])
        best: dict[tuple, tuple] = {}
        # the sum of all bounds is what the first pivot test of the search compares
        for at in np.flatnonzero(sums[last] - sums[first] >= THRESHOLD - 1e-6):
            present = np.unique(term[first[at] : last[at]])
            for entry, score in self.search(present[present < len(self.terms)].tolist(), THRESHOLD):
                number = self.item_of[entry]
                _, grams, answer, length = self.items[number]
                lo, hi = cuts[text[at]], cuts[text[at] + 1]
                near = words[max(lo, first[at] - length) : min(hi, last[at] + TERM_WORDS - 1 + length)]
                own = tx.shingles(near, np.zeros(len(near), np.int64), GRAM)[0]
                question = float(np.isin(grams, own).mean())
                reply = float(np.isin(answer, near).mean()) if len(answer) else 1.0
                if question >= QUESTION_OVERLAP and reply >= ANSWER_OVERLAP:
                    found, key = (question, reply, score, int(lo - first[at])), (int(text[at]), number)
                    best[key] = max(best.get(key, found), found)
        for (at, number), (question, reply, score, word) in sorted(best.items()):
            yield at, self.items[number][0], score, question, reply, -word


def _pass(docs: DataFrame, index) -> DataFrame:
    def rows(batches) -> Iterator[pa.RecordBatch]:
        tests = pickle.loads(index.value)
        for batch in batches:
            data, places = tx.buffers(batch.column("text"))
            ids, out = batch.column("doc").to_pylist(), []
            for first, last in tx.groups(places):
                words, owner, _ = tx.hash_words(data[places[first] : places[last]], places[first : last + 1] - places[first], tx.PUNCTUATION)
                out += [(ids[first + at], *leak) for at, *leak in tests.leaks(words, owner, last - first)]
            if out:
                columns = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.record_batch(arrays, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"])

    return docs.mapInArrow(rows, _SCHEMA)


def _entry_terms(batches) -> Iterator[pa.RecordBatch]:
    """For each entry of each test item its length, with no term, and each of its terms."""
    for batch in batches:
        block, term, length = [], [], []
        for number, text in zip(batch.column("block").to_pylist(), batch.column("t").to_pylist(), strict=True):
            words = _hashes(text)
            for entry in _entries(words) if len(words) >= GRAM else ():
                terms = np.unique(entry).view(np.int64).tolist()
                block += [number] * (len(terms) + 1)
                term += [None, *terms]
                length += [len(entry), *[None] * len(terms)]
        yield pa.record_batch([pa.array(block, pa.int32()), pa.array(term, pa.int64()), pa.array(length, pa.int64())], ["block", "term", "length"])


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame | None, int]:
    """``(block, part, data)``: an index for each block of test items, in parts, and the number of blocks.

    Items are dealt to blocks by their hash, and the blocks are built in tasks. Statistics are counted once over
    all items, so that scores do not depend on the blocks.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null")
    items = stored(items.distinct(), "test-items")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0]
    if not size:
        return None, 0
    blocks = -(-size // INDEX_BYTES)
    items = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int"))
    entries = stored(items.select("block", "t").mapInArrow(_entry_terms, "block int, term bigint, length bigint"), "test-entries")
    count, mean = entries.filter("term is null").agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    mean = max(1.0, mean)
    terms = entries.filter("term is not null")
    used = terms.select("block", "term").distinct().join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("block", "term", "df")

    def build(some: pa.Table, held: pa.Table) -> pa.Table:
        known, counts = (held.column(c).to_numpy() for c in ("term", "df"))
        known = known.astype(np.int64).view(np.uint64)
        order = np.argsort(known)
        rows = sorted(zip(some.column("i").to_pylist(), some.column("t").to_pylist(), strict=True))
        data = pickle.dumps(Index(rows, (count, mean, known[order], counts[order].astype(np.int64))), pickle.HIGHEST_PROTOCOL)
        parts = [data[at : at + PART_BYTES] for at in range(0, len(data), PART_BYTES)]
        block = some.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "part", "data"])

    built = items.groupBy("block").cogroup(used.groupBy("block")).applyInArrow(build, "block int, part int, data binary")
    return stored(built, "test-index"), blocks


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and test item that it holds, with the best passage's score and the overlaps.

    Every passage of ``PASSAGE_WORDS`` words of every text is a query to a BM25 index of the items' word pairs, which gives all
    items with at least ``THRESHOLD`` of their score for themselves. An item counts as leaked if half of the
    three-word runs of its question and half of the words of its answer occur around the passage; where the question
    would have less than three words, the whole item is the question. Words are runs of
    letters and digits, lower-cased. Test sets larger than ``INDEX_BYTES`` are searched in blocks of about that size, one at
    a time, with the statistics of all items. Items of one or two words leak where their whole word sequence occurs. Items without a
    word or an id are left out; texts that are
    null or empty hold nothing; repeated rows are reported each; other columns are ignored.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.lower(F.col(text_col).cast("string")).alias("text"))
    index, blocks = _indexes(benchmark, item_col, item_text_col)
    parts = []
    for block in range(blocks):
        # the index of one block is held at a time, here and in tasks
        held = index.filter(F.col("block") == block).orderBy("part").collect()
        if not held:
            continue
        shared = spark.sparkContext.broadcast(b"".join(bytes(r["data"]) for r in held))
        del held
        hits = _pass(rows, shared)
        if blocks > 1:
            hits = stored(hits, "leaks")
            shared.destroy()
        parts.append(hits)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item. Rows without an id stay."""
    gone = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
