"""Held-out passages that leaked into a corpus, by template windows.

A word is canonicalised to a template token: numbers, unit words and the proper names
of the held-out passages become typed placeholders, every other word stands for itself.
Windows of ``size`` template tokens are hashed and joined; then the slots, the words that
stand for placeholders, decide. Where all slots hold the item's own words the window is a
verbatim leak. Where each slot value of the item is replaced by one and the same other
value throughout, the item was re-parameterised.

What a name is depends on the reading. For verbatim leaks a word is a name wherever its
lower-case form is one in the passages, so that equal words have equal templates in any
case. For re-parameterised leaks, whose names the passages cannot know, a word is a name
where it has a capital inside a sentence.

Document windows are made only where every token is a placeholder or occurs in some
passage. That loses nothing, and leaves a corpus of code and prose with almost none. The
words of the passages go to the executors with the function: passages are taken in
blocks of at most about ``MOST_CHARS`` characters, one pass over the documents each, so
what is sent is bounded and every number of blocks gives the same rows.

Defined results: words are runs of letters and digits, case ignored; markup tags,
punctuation, underscores and line markers between them do not matter; null or empty
texts and passages shorter than the window match nothing; repeated rows and copies each
match; prompts are not test material; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--|-->")
#: Units and number words that take the place of figures.
UNITS = "mm cm m km kg g mg t lb oz l ml s ms min h hours minutes seconds metres meters miles feet inches percent dollars euros".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split()
#: Characters of passages whose words are sent to the executors at once.
MOST_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

WINDOWS = "key long, template long, words long, slots array<string>"
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"


def words_of(text: str) -> list[str]:
    """The words of a text with tags removed, as written."""
    return WORD.findall(TAG.sub(" ", text) if "<" in text else text)


def _starts(before: str) -> bool:
    """Whether a word begins a sentence, by what stands between it and the word before."""
    return not before or any(c in ".!?" for c in before)


def read(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text as written, and which have a capital inside a sentence."""
    text = TAG.sub(" ", text) if "<" in text else text
    words, named, end = [], [], 0
    for m in WORD.finditer(text):
        w = m.group()
        words.append(w)
        named.append(w[0].isupper() and not w.isupper() and end > 0 and not _starts(text[end : m.start()]))
        end = m.end()
    return words, named


def lexicon(items: DataFrame, passage: str = "passage") -> DataFrame:
    """(word, named): the lower-case words of all passages, and whether each is a name: seen
    with a capital inside a sentence and never without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside: dict[str, bool] = {}
            plain: dict[str, bool] = {}
            for text in batch.column(0).to_pylist():
                for w, named in zip(*read(text or "")):
                    lower = w.lower()
                    inside[lower] = inside.get(lower, False) or named
                    plain[lower] = plain.get(lower, False) or w.islower()
            yield pa.RecordBatch.from_arrays([pa.array(list(inside), pa.string()), pa.array(list(inside.values()), pa.bool_()), pa.array(list(plain.values()), pa.bool_())], names=["word", "inside", "plain"])

    seen = items.select(F.col(passage)).mapInArrow(run, "word string, inside boolean, plain boolean")
    return seen.groupBy("word").agg((F.max("inside") & ~F.max("plain")).alias("named"))


def template_of(lower: str, named: bool, vocabulary: dict[str, bool]) -> str:
    """The template token of a word; empty if no passage can hold it."""
    if lower.isdigit() or lower in _NUMBERS:
        return NUMBER
    if named:
        return NAME
    if lower in _UNITS:
        return UNIT
    return lower if lower in vocabulary else ""


_NUMBERS, _UNITS = frozenset(NUMBERS), frozenset(UNITS)


def windows(rows: DataFrame, key: str, text: str, vocabulary: dict[str, bool], size: int, by_case: bool) -> DataFrame:
    """(key, template, words, slots): one row per window of ``size`` words.

    ``template`` and ``words`` are 64-bit hashes of the template and of the words
    themselves; ``slots`` holds the placeholders' words. Names are told by the vocabulary,
    or by their capitals (``by_case``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], tuple[int, int, bool]] = {}
        powers = np.power(BASE, np.arange(size, dtype=np.uint64))

        def code(w: str, named: bool) -> tuple[int, int, bool]:
            c = known.get((w, named))
            if c is None:
                lower = w.lower()
                t = template_of(lower, named if by_case else vocabulary.get(lower, False), vocabulary)
                c = (xxhash.xxh64_intdigest(t) if t else 0, xxhash.xxh64_intdigest(lower), t[:1] == "\x01")
                if len(known) < 2_000_000:
                    known[w, named] = c
            return c

        for batch in batches:
            out_key: list[np.ndarray] = []
            out_t: list[np.ndarray] = []
            out_w: list[np.ndarray] = []
            out_s: list[list[str]] = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                if by_case:
                    found, named = read(body)
                    coded = [code(w, n) for w, n in zip(found, named)]
                else:
                    found = words_of(body)
                    coded = [known.get((w, False)) or code(w, False) for w in found]
                if len(found) < size:
                    continue
                t = np.fromiter((c[0] for c in coded), np.uint64, len(coded))
                n = len(t) - size + 1
                outside = np.r_[0, np.cumsum(t == 0)]
                at = np.flatnonzero(outside[size:] == outside[:n])
                if not len(at):
                    continue
                v = np.fromiter((c[1] for c in coded), np.uint64, len(coded))
                spans = at[:, None] + np.arange(size)
                with np.errstate(over="ignore"):
                    out_t.append((t[spans] * powers).sum(1, dtype=np.uint64))
                    out_w.append((v[spans] * powers).sum(1, dtype=np.uint64))
                out_key.append(np.full(len(at), k, np.int64))
                out_s += [[found[j].lower() for j in range(i, i + size) if coded[j][2]] for i in at.tolist()]
            cat = lambda x, kind: np.concatenate(x).view(np.int64) if x else np.array([], kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(out_key, np.int64)), pa.array(cat(out_t, np.int64)), pa.array(cat(out_w, np.int64)), pa.array(out_s, pa.list_(pa.string()))],
                names=["key", "template", "words", "slots"],
            )

    return rows.select(F.col(key).cast("long"), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(cut, WINDOWS)


def template_matches(documents: DataFrame, items: DataFrame, *, size: int, by_case: bool, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """Pairs of equal template windows: doc, item and both word hashes and slots."""
    items = items.select(item, passage).where(F.col(passage).isNotNull())
    words = lexicon(items, passage)
    chars = items.agg(F.sum(F.length(passage))).first()[0] or 0
    blocks = max(1, -(-chars // MOST_CHARS))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == k)
        own = words if blocks == 1 else words.join(lexicon(block, passage).select("word"), "word", "left_semi")
        vocabulary = {r.word: r.named for r in own.collect()}  # bounded by MOST_CHARS
        held = windows(block, item, passage, vocabulary, size, by_case).distinct()
        held = held.select(F.col("key").alias("item_id"), "template", F.col("words").alias("item_words"), F.col("slots").alias("item_slots"))
        seen = windows(documents, key, text, vocabulary, size, by_case).select(F.col("key").alias("doc_id"), "template", F.col("words").alias("doc_words"), F.col("slots").alias("doc_slots"))
        met = seen.join(held, "template")
        out = met if out is None else out.unionByName(met)
    return out


def leaked(documents: DataFrame, items: DataFrame, *, size: int = 12, **columns: str) -> DataFrame:
    """(doc_id, item_id) where the document holds ``size`` consecutive words of the passage:
    equal templates whose slots hold the item's own words. Equal hashes of the words
    follow as an exact check."""
    met = template_matches(documents, items, size=size, by_case=False, **columns)
    return met.where("doc_slots = item_slots and doc_words = item_words").select("doc_id", "item_id").distinct()


def reparameterised(documents: DataFrame, items: DataFrame, *, size: int = 12, **columns: str) -> DataFrame:
    """(doc_id, item_id, windows, replaced): documents that repeat an item's template with
    other names, numbers or units, each replaced consistently wherever it occurs."""
    met = template_matches(documents, items, size=size, by_case=True, **columns).where("size(item_slots) > 0")
    pairs = met.select("doc_id", "item_id", "template", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("z")).select(
        "doc_id", "item_id", "template", F.col("z.item_slots").alias("old"), F.col("z.doc_slots").alias("new")
    )
    by_value = pairs.groupBy("doc_id", "item_id", "old").agg(
        F.min("new").alias("lo"), F.max("new").alias("hi"), F.count_distinct("template").alias("n")
    )
    return (
        by_value.groupBy("doc_id", "item_id")
        .agg(F.max(F.when(F.col("lo") != F.col("hi"), 1).otherwise(0)).alias("torn"), F.count_if(F.col("old") != F.col("lo")).alias("replaced"), F.max("n").alias("windows"))
        .where("torn = 0 and replaced > 0")
        .select("doc_id", "item_id", "windows", "replaced")
    )
