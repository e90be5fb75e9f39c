"""Subject areas of documents by subject-specific interpolated n-gram language models.

1. One pass over all documents turns each text into word hashes; corpus counts, training
   and scoring read that table, never the texts again.
2. A bounded sample of labelled documents (``sample``) starts one model per subject. A model
   gives a word's probability after the word before it: an interpolation of the subject's
   bigrams, its words and the background. The background is what the subjects share (the
   median subject's rate), smoothed with the counts over the whole corpus, so that a
   subject that fills a quarter of the corpus does not become background itself. Where a
   subject uses a word no more than the corpus does, its model backs off to the background,
   and the cross-entropies of that word are equal.
3. The models are then estimated anew over the whole corpus from the documents that they
   place clearly in a single subject, ``rounds`` times. Few or wrong labels so weigh
   little, and words that no label covers are learnt. Bigrams are counted in the last round.
4. Per document, the difference between background and subject cross-entropy is taken per
   token and averaged over the repeats of a word, so that no word can carry a document by
   being repeated. Words are shared out among subjects and background by expectation
   maximisation: a word that several subjects use is explained by the one that the rest of
   the text speaks for. What is left to a subject is the nats that it saves.
5. How many nats make a subject accepted is calibrated on the labelled documents that did
   not train the first model: the chance of a label is a logistic curve of the nats,
   between the share of wrong labels and the share of subjects that are labelled at all,
   since labels are incomplete. Subjects beyond the curve's middle are accepted.

Bounds: words in less than one of 100,000 documents and bigrams of less than one of
100,000 tokens of a subject are not modelled. Both are shares, so they hold alike at every
size, and bound the models by what a document and a subject hold on average.

Several subjects may be accepted. Defined results: header lines (commit, author, date,
sign-off, index) and addresses (URLs) are no text; null, empty and unmarked texts have no subject; labels of
unknown documents are ignored; repeated labels count once; documents are judged alike at
every corpus size; empty in, empty out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.workspace import cut, scratch

HEADER = re.compile(r"^(?:commit [0-9a-f]{7,}\b|Author:|From(?::| [0-9a-f]{7,}\b)|Date:|index [0-9a-f]+[., ]|@@|\s*Signed-off-by:|\s*\(cherry picked).*$|[A-Za-z][\w+.-]*://\S+", re.M)
TOKEN = re.compile(r"(?<![^\W_])[^\W\d_]{3,}+(?!\d)")
CAMEL = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+")

#: Labelled documents that the first models and the calibration are made of.
SAMPLE = 20_000
#: One of so many labelled documents is held out for the calibration.
HELD = 4
#: Words in fewer documents, or in a smaller share of them, are not modelled.
LEAST_DOCS, LEAST_SHARE = 3, 1e-5
#: Bigrams seen less often, or in a smaller share of a subject's tokens, are not modelled.
LEAST_PAIRS, LEAST_PAIR_SHARE = 4, 1e-5
#: Weights of bigrams, words and background in the interpolated model.
LAMBDA = (0.25, 0.70, 0.05)
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Lower-case words of at least three letters; identifiers are taken apart."""
    out = []
    for t in TOKEN.findall(HEADER.sub(" ", text)):
        if t.islower() or t.isupper():
            out.append(t.lower())
        else:
            out += [p.lower() for p in CAMEL.findall(t) if len(p) > 2]
    return out


@dataclass
class Model:
    subjects: list[str]
    words: np.ndarray  # sorted hashes of the words that tell of some subject
    own: np.ndarray  # words x subjects: probability within a subject
    telling: np.ndarray  # words x subjects: does the subject use the word significantly more than the corpus
    background: np.ndarray  # words: probability in the background
    pairs: np.ndarray  # sorted keys of (word before, word)
    after: np.ndarray  # pairs x subjects: probability after the word before, within a subject
    after_bg: np.ndarray  # pairs: the same in the background
    least_nats: float = 0.0


def _find(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array, -1 where it has none."""
    if not len(held):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, at, -1)


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return before * MIX ^ word


def hashed(documents: DataFrame) -> DataFrame:
    """(doc_id, words): each document as the 64-bit hashes of its words. Written once."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ws = tokens(text or "")
                for w in ws:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w)
                out.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)).tobytes())
                if len(known) > 2_000_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])

    path = scratch(documents.sparkSession, "words")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows.mapInArrow(number, "doc_id long, words binary").write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def _open(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """All hashes of a batch, the document that each belongs to, and the number of documents."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint64), np.repeat(np.arange(len(held)), [len(h) // 8 for h in held]), len(held)


def _counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with their tokens and the documents that hold them."""
    words, at = np.unique(hashes, return_inverse=True)
    once = np.unique(doc * len(words) + at) % len(words)
    return words, np.bincount(at, minlength=len(words)), np.bincount(once, minlength=len(words))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, all_docs, all_n) of the words that are in enough documents, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, _ = _open(batch.column(0))
            if len(hashes):
                words, n, held = _counted(hashes, doc)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(held), pa.array(n)], names=["word", "docs", "n"])

    counted = docs.select("words").mapInArrow(count, "word long, docs long, n long").groupBy("word").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("all_n"))
    return counted.where(F.col("all_docs") >= max(LEAST_DOCS, LEAST_SHARE * docs.count()))


SEEN = "subject int, word long, n long, docs long"


def _by_subject(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of words by subject; word 0 counts tokens and documents of the subject."""
    for s in np.unique(place[place >= 0]):
        mine = place[doc] == s
        words, n, held = _counted(hashes[mine], doc[mine])
        words, n, held = np.r_[words.view(np.int64), 0], np.r_[n, mine.sum()], np.r_[held, (place == s).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), s), pa.int32()), pa.array(words), pa.array(n), pa.array(held)], names=["subject", "word", "n", "docs"])


def labelled_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Counts of words by subject in the labelled documents ``chosen`` (doc_id, subject as a number)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, _ = _open(batch.column(1))
            yield from _by_subject(hashes, doc, np.asarray(batch.column(0)))

    return chosen.join(docs, "doc_id").select("subject", "words").mapInArrow(count, SEEN)


def estimate(seen: DataFrame, corpus: DataFrame, n_docs: int, total: int, subjects: list[str], least_z: float, old: Model | None = None) -> Model:
    """The word models from counts by subject. Only the words that tell of a subject leave the executors.

    A word tells of a subject if its documents have it significantly more often than all
    documents, and four times as often as those of the other subjects. A subject with hardly
    a document keeps its words of ``old``."""
    counted = cut(seen.groupBy("subject", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    size, held = np.zeros(len(subjects)), np.zeros(len(subjects))
    for s, n, d in counted.where("word = 0").select("subject", "n", "docs").collect():  # one row per subject
        size[s], held[s] = n, d
    sizes = F.array(*[F.lit(float(d)) for d in held])
    of = lambda x: F.element_at(sizes, x["subject"] + 1)
    p = F.col("all_docs") / F.lit(float(max(n_docs, 1)))
    rows = counted.where("word <> 0").groupBy("word").agg(F.collect_list(F.struct("subject", "n", "docs")).alias("by")).join(corpus, "word")  # one entry per subject
    whole = F.aggregate("by", F.lit(0.0), lambda a, x: a + x["docs"])

    def tells(x: Column) -> Column:
        z = (x["docs"] - of(x) * p) / F.sqrt(F.greatest(of(x) * p * (1 - p), F.lit(1e-9)))
        other = (whole - x["docs"] + 0.5) / F.greatest(F.lit(float(held.sum())) - of(x), F.lit(1.0))
        return (z >= least_z) & (x["docs"] >= F.when(of(x) < 6, 1).otherwise(2)) & (x["docs"] / F.greatest(of(x), F.lit(1.0)) >= 4 * other)

    told = rows.withColumn("tells", F.transform(F.filter("by", tells), lambda x: x["subject"])).where("size(tells) > 0")
    found = sorted((r.word & (2**64 - 1), r) for r in told.collect())
    words = np.array([w for w, _ in found], np.uint64)
    own, telling, rate = np.zeros((len(words), len(subjects))), np.zeros((len(words), len(subjects)), bool), np.zeros(len(words))
    for i, (_, r) in enumerate(found):
        rate[i] = r.all_n / max(total, 1)
        telling[i, r.tells] = True
        for x in r.by:
            own[i, x.subject] = x.n / max(size[x.subject], 1)
    if old is not None and (few := held < 5).any():
        words, own, telling, rate = _with_old(words, own, telling, rate, old, few)
    background = 0.98 * np.median(own, axis=1) + 0.02 * rate + 1e-8
    none = np.zeros(0)
    return Model(subjects, words, own, telling, background, np.zeros(0, np.uint64), np.zeros((0, len(subjects))), none)


def _with_old(words: np.ndarray, own: np.ndarray, telling: np.ndarray, rate: np.ndarray, old: Model, few: np.ndarray) -> tuple[np.ndarray, ...]:
    """The models with the columns of ``few`` subjects taken from the old ones."""
    union = np.union1d(words, old.words)
    new_at, old_at = _find(words, union), _find(old.words, union)
    pick = lambda a, at: np.where((at >= 0).reshape(-1, *[1] * (a.ndim - 1)), a[np.maximum(at, 0)] if len(a) else np.zeros((len(union), *a.shape[1:]), a.dtype), 0)
    return (
        union, np.where(few, pick(old.own, old_at), pick(own, new_at)), np.where(few, pick(old.telling, old_at), pick(telling, new_at)).astype(bool),
        np.where(new_at >= 0, pick(rate, new_at), pick(old.background, old_at)),
    )


def _types(hashes: np.ndarray, doc: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document and distinct word that tells: document, word and likelihood ratios of the
    subjects against the background, as geometric means over the word's tokens."""
    l2, l1, l0 = LAMBDA
    at = _find(m.words, hashes)
    keep = np.flatnonzero(at >= 0)
    ids, d = at[keep], doc[keep]
    own, bg = m.own[ids], m.background[ids][:, None]
    p, q = (l2 + l1) * own + l0 * bg, np.repeat(bg, own.shape[1], axis=1)
    if len(m.pairs):
        first = np.r_[True, doc[1:] != doc[:-1]][keep]
        before = np.where(first, np.uint64(0), hashes[np.maximum(keep - 1, 0)])
        place = _find(m.pairs, _pair(before, hashes[keep]))
        hit = np.flatnonzero((place >= 0) & ~first)
        p[hit] += l2 * (m.after[place[hit]] - own[hit])
        q[hit] += l2 * (m.after_bg[place[hit]][:, None] - q[hit])
    gain = np.log(np.maximum(p, 1e-12) / q)
    gain = np.where(m.telling[ids], gain, np.minimum(gain, 0.0))
    order = np.lexsort((ids, d))
    ids, d, gain = ids[order], d[order], gain[order]
    start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (d[1:] != d[:-1])]) if len(ids) else np.zeros(0, int)
    if not len(start):
        return d, ids, gain
    many = np.diff(np.r_[start, len(ids)])
    return d[start], ids[start], np.add.reduceat(gain, start, axis=0) / many[:, None]


def score(hashes: np.ndarray, doc: np.ndarray, n_docs: int, m: Model, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Per document and subject: how many different words it explains, and the nats it saves."""
    s = len(m.subjects)
    got, saved = np.zeros((n_docs, s)), np.zeros((n_docs, s))
    d, _, gain = _types(hashes, doc, m)
    if not len(d):
        return got, saved
    ratio = np.exp(np.clip(gain, -7, 12)).astype(np.float32)
    start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    here, length = d[start], np.diff(np.r_[start, len(d)])
    theta, rest = np.full((len(here), s), 0.5 / s, np.float32), np.full(len(here), 0.5, np.float32)
    share = sums = None
    for _ in range(rounds):
        share = np.repeat(theta, length, axis=0) * ratio
        share /= (share.sum(1) + np.repeat(rest, length))[:, None]
        sums = np.add.reduceat(share, start, axis=0)
        theta = (sums + np.float32(0.02)) / (length[:, None] + np.float32(1.0))
        rest = np.maximum(1 - theta.sum(1), np.float32(0.05))
    got[here] = sums
    saved[here] = np.add.reduceat(share * gain, start, axis=0)
    return got, saved


def _clear(got: np.ndarray) -> np.ndarray:
    """The subject that a document is clearly of alone, -1 where there is none."""
    if not len(got):
        return np.zeros(0, int)
    ordered = np.sort(got, axis=1)
    second = ordered[:, -2] if got.shape[1] > 1 else np.zeros(len(got))
    return np.where((ordered[:, -1] >= 3) & (second <= 1.0), got.argmax(1), -1)


def clear_counts(docs: DataFrame, model: Model) -> DataFrame:
    """Counts of words by subject over all documents that are clearly of one subject."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, n = _open(batch.column(0))
            if len(hashes):
                yield from _by_subject(hashes, doc, _clear(score(hashes, doc, n, model, rounds=5)[0]))

    return docs.select("words").mapInArrow(count, SEEN)


def with_bigrams(docs: DataFrame, model: Model) -> Model:
    """The model with the bigrams of the documents that are clearly of one subject.

    Counts are of pairs whose second word tells of some subject, and of their first words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, n = _open(batch.column(0))
            if len(hashes) < 2:
                continue
            place = _clear(score(hashes, doc, n, model, rounds=5)[0])
            subject = place[doc]
            use = np.flatnonzero((subject[1:] >= 0) & (doc[1:] == doc[:-1]))
            before, word, of = hashes[use], hashes[use + 1], subject[use]
            tell = _find(model.words, word) >= 0
            # word 0 counts the first word itself; both of it are 0 for all pairs of the subject
            for s in np.unique(of):
                mine = of == s
                firsts, n1 = np.unique(before[mine], return_counts=True)
                both, n2 = np.unique(np.stack([before[mine & tell], word[mine & tell]]), axis=1, return_counts=True)
                a, b, k = np.r_[firsts, both[0], [np.uint64(0)]], np.r_[np.zeros(len(firsts), np.uint64), both[1], [np.uint64(0)]], np.r_[n1, n2, mine.sum()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s), pa.int32()), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64)), pa.array(k)], names=["subject", "before", "word", "n"])

    counted = cut(docs.select("words").mapInArrow(count, "subject int, before long, word long, n long").groupBy("subject", "before", "word").agg(F.sum("n").alias("n")))
    total = counted.where("before = 0 and word = 0").select("subject", F.col("n").alias("total"))  # one row per subject
    firsts = counted.where("before <> 0 and word = 0").select("subject", "before", F.col("n").alias("first"))
    often = counted.where("word <> 0").join(F.broadcast(total), "subject").where(F.col("n") >= F.greatest(F.lit(LEAST_PAIRS), F.lit(LEAST_PAIR_SHARE) * F.col("total")))
    rows = often.select("before", "word").distinct().join(counted.where("word <> 0"), ["before", "word"]).join(firsts, ["subject", "before"]).select("before", "word", "subject", (F.col("n") / F.col("first")).alias("p"))
    found = rows.collect()  # at most 1 / LEAST_PAIR_SHARE pairs by subject
    if not found:
        return model
    keys = _pair(np.array([r.before & (2**64 - 1) for r in found], np.uint64), np.array([r.word & (2**64 - 1) for r in found], np.uint64))
    pairs, at = np.unique(keys, return_inverse=True)
    after, word = np.zeros((len(pairs), len(model.subjects))), np.zeros(len(pairs), int)
    for i, r in zip(at, found):
        after[i, r.subject] = r.p
    word[at] = _find(model.words, np.array([r.word & (2**64 - 1) for r in found], np.uint64))
    return replace(model, pairs=pairs, after=after, after_bg=0.98 * np.median(after, axis=1) + 0.02 * model.background[word])


def calibrated(nats: np.ndarray, labelled: np.ndarray) -> float:
    """Nats from which a subject is accepted, from held-out pairs of document and subject.

    The chance of a label is ``e + (c - e) / (1 + exp(a (b - nats)))``: e for wrong labels, c
    because not all subjects of a document are labelled. The likeliest b is returned."""
    x, n = np.unique(np.stack([np.round(np.clip(nats, -1, 80) * 4) / 4, labelled]), axis=1, return_counts=True)
    a, b, c, e = (v.reshape(-1, 1) for v in np.meshgrid([0.25, 0.5, 1.0], np.arange(1, 40.25, 0.25), [0.5, 0.6, 0.7, 0.8, 0.9, 0.97], [0.001, 0.003, 0.01, 0.03], indexing="ij"))
    p = e + (c - e) / (1 + np.exp(np.clip(a * (b - x[0]), -50, 50)))
    chance = (n * np.where(x[1] > 0, np.log(p), np.log1p(-p))).sum(1)
    return float(b[chance.argmax(), 0])


def _held_out(docs: DataFrame, labels: DataFrame, model: Model) -> float:
    """The calibrated acceptance of the held-out labels (doc_id, subjects as numbers)."""
    s = len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, n = _open(batch.column(1))
            saved = score(hashes, doc, n, model)[1]
            marked = np.zeros((n, s), bool)
            for i, own in enumerate(batch.column(0).to_pylist()):
                marked[i, own] = True
            yield pa.RecordBatch.from_arrays([pa.array(saved.ravel()), pa.array(marked.ravel())], names=["nats", "labelled"])

    rows = labels.join(docs, "doc_id").select("subjects", "words").mapInArrow(run, "nats double, labelled boolean").toPandas()  # at most SAMPLE documents
    return calibrated(rows["nats"].to_numpy(float), rows["labelled"].to_numpy(float))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rounds: int = 3) -> Model | None:
    """The models and their acceptance; None without any label of a document."""
    known = labels.where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "subject").distinct().join(docs.select("doc_id").distinct(), "doc_id")
    grouped = known.groupBy("doc_id").agg(F.sort_array(F.collect_list("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id")).limit(sample)
    chosen = cut(grouped)
    subjects = sorted(r[0] for r in chosen.select(F.explode("subjects")).distinct().collect())  # of at most ``sample`` documents
    if not subjects:
        return None
    number = F.array(*map(F.lit, subjects))
    chosen = chosen.select("doc_id", F.transform("subjects", lambda x: (F.array_position(number, x) - 1).cast("int")).alias("subjects"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD)) == 0).alias("held"))
    corpus = cut(corpus_counts(docs))
    n_docs, total = docs.count(), corpus.agg(F.sum("all_n")).first()[0] or 1
    first = chosen.where("not held").select("doc_id", F.explode("subjects").alias("subject"))
    model = estimate(labelled_counts(docs, first), corpus, n_docs, total, subjects, 3.5)
    for _ in range(rounds):
        model = estimate(clear_counts(docs, model), corpus, n_docs, total, subjects, 5.0, model)
    model = with_bigrams(docs, model)
    return replace(model, least_nats=_held_out(docs, chosen.where("held").select("doc_id", "subjects"), model))


def subjects_of(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rounds: int = 3) -> DataFrame:
    """(doc_id, subject) of every subject that a document deals with."""
    docs = hashed(documents)
    schema = "doc_id long, subject string"
    model = train(docs, labels, sample=sample, rounds=rounds)
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.subjects, object)
        for batch in batches:
            hashes, doc, n = _open(batch.column(1))
            if not len(hashes):
                continue
            d, j = np.nonzero(score(hashes, doc, n, model)[1] >= model.least_nats)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(names[j], pa.string())], names=["doc_id", "subject"])

    return docs.mapInArrow(judge, schema)


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many of all documents deal with a subject."""
    total = documents.count()
    return found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents")).withColumn("share", F.round(F.col("documents") / max(total, 1), 6))
