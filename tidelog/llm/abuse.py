"""Abusive, hateful or sexual content: gradient-boosted trees over dense features, with isotonic calibration.

1. Of the labelled documents, a bounded sample, the words are coded (see reveal) and kept.
2. The patterns of words that tell toxic documents from others are counted over that sample, in folds, and weighted.
3. Every text becomes one vector of dense features: densities of the word lists and of the learnt patterns, how near
   listed words stand to the second person, to a group of people or to plain technical surroundings, and rates of
   capitals, punctuation and disguise. Vectors to fit by take the weights of a document's patterns from the other folds.
4. Trees are grown on the labelled vectors, calibrated on documents they have not seen, and one scan scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import evidence as E
from tidelog.llm import lexicon as L
from tidelog.llm import reveal as R
from tidelog.llm.trees import Trees, isotonic
from tidelog.session import materialize, scratch

#: At most so many labelled documents are used to fit, the ones with the least hashes.
LABELLED_MAX = 20_000
#: Below so many labelled documents of either kind nothing is learnt; see Model.
LABELLED_MIN = 8
#: At most so many patterns are weighted, the ones that most of the sample's documents hold.
PATTERNS_MAX = 1 << 18
FOLDS = 5
#: Words to either side of a listed one that are its surroundings.
WINDOW = 9
#: Texts are looked at in slices of about so many characters; a longer text is a slice.
SLICE_CHARS = 1 << 20

_HOT = L.CATEGORIES[: L.N_HOT]
FEATURES = (
    *(f"{c}_n" for c in _HOT), *(f"{c}_density" for c in _HOT), *(f"{c}_window" for c in _HOT), *(f"{c}_near_second" for c in _HOT),
    "hate_near_group", "hate_near_name", "threat_near_group", "mild_near_group", "mild_near_name", "sexual_near_person", "kinds_in_window",
    "hot_in_window", "hot_less_plain", "hits_unplain", "second_density", "group_n", "plain_density",
    "caps_rate", "caps_hits", "bang_rate", "question_rate", "disguised_hits", "disguised_rate", "invisible_rate",
    "learnt_best", "learnt_second", "learnt_least", "learnt_strong", "learnt_density", "learnt_at_hit", "learnt_near_second",
)
AT = {f: i for i, f in enumerate(FEATURES)}
#: Rates that only the written text tells, not its words.
WRITTEN = ("caps_rate", "bang_rate", "question_rate", "invisible_rate")
#: A weight from which a pattern counts as strong.
STRONG = 2.0


def written(text: str) -> list[float]:
    """The features of WRITTEN: shares of the text's characters."""
    n = max(1, len(text))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    hidden = 0 if text.isascii() else sum(map(len, L.INVISIBLE.findall(text)))
    return [upper / n, text.count("!") / n, text.count("?") / n, 1000 * hidden / n]


def _best(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The greatest value of each document, 0 at least."""
    out = np.zeros(n_docs)
    np.maximum.at(out, doc, values)
    return out


def _nearness(hits: np.ndarray, others: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each hit WINDOW + 1 less the distance to the nearest of the others in its document, 0 if none is near."""
    if not len(others) or not len(hits):
        return np.zeros(len(hits))
    # Documents are set apart by more than a window.
    at, have = hits + doc[hits] * 2 * WINDOW, others + doc[others] * 2 * WINDOW
    k = np.searchsorted(have, at)
    after = np.abs(have[np.minimum(k, len(have) - 1)] - at)
    before = np.abs(have[np.maximum(k - 1, 0)] - at)
    # A word is not near to itself.
    after = np.where(after == 0, np.abs(have[np.minimum(k + 1, len(have) - 1)] - at), after)
    after = np.where(after == 0, WINDOW + 1, after)
    return np.maximum(WINDOW + 1 - np.minimum(after, np.where(before == 0, WINDOW + 1, before)), 0)


def vectors(codes: np.ndarray, doc: np.ndarray, rates: np.ndarray, lookup: E.Lookup | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """The features of documents. `codes` are their words, one document after the other, `doc` the document of each;
    `rates` has the features of WRITTEN; patterns in `lookup` have the given weights."""
    n = len(rates)
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, values: out.__setitem__((slice(None), AT[name]), values)
    for k, name in enumerate(WRITTEN):
        put(name, rates[:, k])
    if not len(codes):
        return out.astype(np.float32)
    n_words = np.maximum(np.bincount(doc, minlength=n), 1)
    bits = codes >> R.CATEGORY_SHIFT
    is_of = {c: bits >> k & 1 > 0 for k, c in enumerate(L.CATEGORIES)}
    total = {c: np.concatenate([[0], np.cumsum(v)]) for c, v in is_of.items()}
    hot = np.flatnonzero(bits & L.HOT)
    lo = np.maximum(np.searchsorted(doc, doc[hot]), hot - WINDOW)
    hi = np.minimum(np.searchsorted(doc, doc[hot], "right"), hot + WINDOW + 1)
    around = {c: total[c][hi] - total[c][lo] for c in L.CATEGORIES}
    second = np.flatnonzero(is_of["second"])
    you = _nearness(hot, second, doc)
    for c in _HOT:
        count = np.bincount(doc[is_of[c]], minlength=n)
        put(f"{c}_n", count)
        put(f"{c}_density", 100 * count / n_words)
        put(f"{c}_window", _best(around[c], doc[hot], n))
        put(f"{c}_near_second", _best(you * is_of[c][hot], doc[hot], n))
    # A name: a capital inside a sentence, or a plural that no list has.
    opens = np.concatenate([[True], (codes[:-1] & R.END > 0) | (doc[1:] != doc[:-1])])
    name = ((codes & R.CAPITAL > 0) & ~opens) | ((codes & R.PLURAL > 0) & (bits & (1 << len(L.CATEGORIES)) - 1 == 0))
    group, names = np.flatnonzero(is_of["group"]), np.flatnonzero(name)
    to_group, to_name = _nearness(hot, group, doc), _nearness(hot, names, doc)
    person = _nearness(hot, np.flatnonzero(is_of["second"] | is_of["first"] | is_of["people"]), doc)
    put("hate_near_group", _best(to_group * is_of["hate"][hot], doc[hot], n))
    put("hate_near_name", _best(to_name * is_of["hate"][hot], doc[hot], n))
    put("threat_near_group", _best(to_group * is_of["threat"][hot], doc[hot], n))
    put("mild_near_group", _best(to_group * is_of["mild_insult"][hot], doc[hot], n))
    put("mild_near_name", _best(to_name * is_of["mild_insult"][hot], doc[hot], n))
    put("sexual_near_person", _best(person * (is_of["sexual"] | is_of["mild_sexual"])[hot], doc[hot], n))
    near = np.stack([around[c] for c in _HOT], 1)
    put("kinds_in_window", _best((near > 0).sum(1), doc[hot], n))
    put("hot_in_window", _best(near.sum(1), doc[hot], n))
    put("hot_less_plain", _best(near.sum(1) - around["plain"], doc[hot], n))
    put("hits_unplain", np.bincount(doc[hot[around["plain"] == 0]], minlength=n))
    put("second_density", 100 * np.bincount(doc[second], minlength=n) / n_words)
    put("group_n", np.bincount(doc[group], minlength=n))
    put("plain_density", 100 * np.bincount(doc[is_of["plain"]], minlength=n) / n_words)
    put("caps_hits", np.bincount(doc[hot[codes[hot] & R.UPPER > 0]], minlength=n))
    disguised = np.bincount(doc[codes & R.DISGUISE > 0], minlength=n)
    put("disguised_hits", disguised)
    put("disguised_rate", 100 * disguised / n_words)
    if lookup is not None and len(lookup.hashes):
        w = E.along(codes, doc, lookup, weight)
        span = E.spans(w, doc)
        put("learnt_best", _best(span, doc, n))
        put("learnt_second", _best(E.spans(np.maximum(w, 0), doc, 3), doc, n))
        put("learnt_least", _best(-span, doc, n))
        strong = w > STRONG
        put("learnt_strong", np.bincount(doc[strong], minlength=n))
        put("learnt_density", 100 * np.bincount(doc, np.maximum(w, 0), minlength=n) / n_words)
        put("learnt_near_second", _best(_nearness(np.flatnonzero(strong), second, doc), doc[strong], n))
        # The span that holds a hit in its midst.
        put("learnt_at_hit", _best(span[np.maximum(hot - E.SPAN // 2, np.searchsorted(doc, doc[hot]))], doc[hot], n))
    return out.astype(np.float32)


def _read(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, codes, document, rates) of slices of texts; null texts are empty."""
    lo = held = 0
    codes: list[np.ndarray] = []
    rates: list[list[float]] = []
    for i, text in enumerate(texts):
        codes.append(R.coded(text or ""))
        rates.append(written(text or ""))
        held += len(text or "")
        if held >= SLICE_CHARS or i == len(texts) - 1:
            doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            yield lo, i + 1, np.concatenate(codes), doc, np.array(rates)
            lo, held, codes, rates = i + 1, 0, [], []


def vector(text: str, lookup: E.Lookup | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """The features of one text, by FEATURES."""
    _, _, codes, doc, rates = next(_read([text]))
    return vectors(codes, doc, rates, lookup, weight)[0]


# -- the labelled sample ---------------------------------------------------------------------------------------


def labelled(labels: DataFrame, most: int = LABELLED_MAX) -> DataFrame:
    """(doc_id, y): the majority of each document's judgements; ties and nulls are left out. At most `most` rows."""
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("bigint"))
    y = votes.agg(F.avg(F.col("toxic").cast("double")).alias("y")).filter("y <> 0.5")
    return y.select("doc_id", F.round("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


SAMPLE = "doc_id bigint, y double, fold int, rates array<double>, codes array<bigint>"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for lo, hi, codes, doc, rates in _read(texts):
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(WRITTEN), pa.int32()), pa.array(rates.ravel()))
            head = [batch.column(c).slice(lo, hi - lo) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*head, flat, lists], ["doc_id", "y", "fold", "rates", "codes"])


def sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED_MAX) -> DataFrame:
    """The labelled documents, at most `most` of them, with their coded words and rates."""
    chosen = F.broadcast(labelled(labels, most))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A document that occurs more than once counts as one.
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    joined = docs.join(chosen, "doc_id").select("doc_id", "y", fold.alias("fold"), "text")
    return joined.mapInArrow(_sample, SAMPLE)


def _slices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, fold, rates, codes, document) of a batch of the sample."""
    codes = batch["codes"]
    n = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), n)
    rates = np.array(batch["rates"].to_pylist()).reshape(-1, len(WRITTEN))
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return batch["y"].to_numpy(zero_copy_only=False), batch["fold"].to_numpy(zero_copy_only=False), rates, flat, doc


def _small(batch: pa.RecordBatch, words: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many words; a longer document is a part."""
    ends = np.cumsum(batch["codes"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + words, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic, clean): the documents of the part that hold each pattern of interest."""
    for batch in batches:
        for part in _small(batch):
            y, _, _, codes, doc = _slices(part)
            h, d = E.counted(codes, doc, y > 0)
            if not len(h):
                continue
            kinds, first = np.unique(h, return_index=True)
            toxic = np.add.reduceat((y[d] > 0).astype(np.int64), first)
            both = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["h", "toxic", "clean"])


def _fold_tally(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = E.Lookup(hashes)
        counts = np.zeros((len(hashes), 2 * FOLDS), np.int64)
        for batch in batches:
            for part in _small(batch):
                y, fold, _, codes, doc = _slices(part)
                which, d = E.held(codes, doc, lookup)
                np.add.at(counts, (which, 2 * fold[d] + (y[d] > 0)), 1)
        at, column = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(column), pa.array(counts[at, column])], ["at", "col", "n"])

    return run


class Evidence:
    """Patterns with their weights by all of the sample, and by all folds but one."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        """`counts`: for each hash and fold the clean and the toxic documents that hold it; `totals`: those of each fold."""
        self.hashes = hashes
        every, of = counts.sum(1), totals.sum(0)
        self.all = E.weights(every[:, 1], every[:, 0], of[1], of[0])
        self.without = [
            E.weights(every[:, 1] - counts[:, k, 1], every[:, 0] - counts[:, k, 0], of[1] - totals[k, 1], of[0] - totals[k, 0])
            for k in range(counts.shape[1])
        ]


def totals(rows: DataFrame) -> np.ndarray:
    """For each fold how many documents of the sample are clean, and how many toxic."""
    out = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", (F.col("y") > 0).cast("int").alias("toxic")).count().collect():
        out[r.fold, r.toxic] = r["count"]
    return out


def learn(rows: DataFrame, of: np.ndarray, most: int = PATTERNS_MAX) -> Evidence:
    """The evidence of a sample with the given totals(): patterns that two toxic documents hold, or three others near a
    listed word, at most `most` of them."""
    seen = rows.select("y", "fold", "rates", "codes").mapInArrow(_tally, "h bigint, toxic bigint, clean bigint")
    enough = seen.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 2 OR clean >= 3")
    chosen = enough.orderBy(F.desc(F.col("toxic") + F.col("clean")), "h").limit(most).select("h").toArrow()
    hashes = np.sort(chosen["h"].to_numpy().view(np.uint64))
    split = rows.select("y", "fold", "rates", "codes").mapInArrow(_fold_tally(hashes), "at bigint, col bigint, n bigint")
    got = split.groupBy("at", "col").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(hashes), 2 * FOLDS), np.int64)
    counts[got["at"].to_numpy(), got["col"].to_numpy()] = got["n"].to_numpy()
    return Evidence(hashes, counts.reshape(-1, FOLDS, 2), of)


def sample_vectors(evidence: Evidence):
    """Rows of the sample to (doc_id, y, fold, features): each document by the weights of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = E.Lookup(evidence.hashes)
        for batch in batches:
            for part in _small(batch):
                y, fold, rates, codes, doc = _slices(part)
                x = np.zeros((len(y), len(FEATURES)), np.float32)
                for k in np.unique(fold):
                    mine = fold == k
                    words = mine[doc]
                    x[mine] = vectors(codes[words], (np.cumsum(mine) - 1)[doc[words]], rates[mine], lookup, evidence.without[k])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], part["fold"], flat], ["doc_id", "y", "fold", "features"])

    return run


#: The weight, beside a document as it is, of the document as if its wording were new.
UNLEARNT_WEIGHT = 0.3
#: What the learnt patterns say in favour of abuse.
_LEARNT = [AT[f] for f in ("learnt_best", "learnt_second", "learnt_strong", "learnt_density", "learnt_near_second")]


def unlearnt(x: np.ndarray) -> np.ndarray:
    """The vectors as they would be had no pattern in favour of abuse been met before."""
    out = x.copy()
    out[:, _LEARNT] = 0
    out[:, AT["learnt_at_hit"]] = 0
    return out


def _grown(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees grown on every document as it is and once more as if its wording were new, so that the lists decide where
    the patterns do not."""
    weight = np.repeat([1.0, UNLEARNT_WEIGHT], len(y))
    return Trees().fit(np.concatenate([x, unlearnt(x)]), np.concatenate([y, y]), weight)


class Model:
    """Evidence, trees and calibration; with too few labels of either kind to learn, the share of toxic ones alone."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, evidence: Evidence | None = None):
        self.trees: Trees | None = None
        self.share = float(y.mean()) if len(y) else 0.0
        self.evidence = evidence
        if min(y.sum(), len(y) - y.sum()) < LABELLED_MIN:
            return
        # Calibrated on scores each document gets from trees grown without its fold.
        held = np.empty(len(y))
        for k in np.unique(fold):
            held[fold == k] = _grown(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.held = held
        self.steps = isotonic(held, y)
        self.trees = _grown(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        at = np.searchsorted(self.steps[0], self.trees.margin(x), "right") - 1
        return self.steps[1][np.maximum(at, 0)]


def fit(documents: DataFrame, labels: DataFrame, most: int = LABELLED_MAX) -> Model:
    """The model fitted on at most `most` labelled documents; the sample is kept on disk while it is needed."""
    with scratch(documents.sparkSession):
        return _fit(materialize(sample(documents, labels, most), "labelled"), most)


def _fit(rows: DataFrame, most: int) -> Model:
    of = totals(rows)
    clean, toxic = of.sum(0).astype(int)
    if min(clean, toxic) < LABELLED_MIN:
        return Model(np.zeros((0, len(FEATURES))), np.repeat([0.0, 1.0], [clean, toxic]), np.zeros(0))
    evidence = learn(rows, of)
    # As many rows as labels were chosen, unless an id occurs in several documents; of those one is taken.
    schema = "doc_id bigint, y double, fold int, features array<float>"
    by_doc = rows.mapInArrow(sample_vectors(evidence), schema).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most)
    got = by_doc.toArrow()
    x = got["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return Model(x, got["y"].to_numpy().astype(float), got["fold"].to_numpy(), evidence)


def scores(documents: DataFrame, labels: DataFrame, most: int = LABELLED_MAX) -> DataFrame:
    """(doc_id, source, score): the calibrated probability that a document is abusive, hateful or sexual.

    Every row of `documents` gives one row; ids may be null or repeated. Null and empty texts have the score of a text
    without any word. Labels may be null, repeated, contradictory or wrong; with fewer than LABELLED_MIN of either kind
    nothing can be learnt, and every document has the share of toxic labels for its score, 0 without labels. Source is
    given as it is; extra columns are ignored.
    """
    model = fit(documents, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = E.Lookup(model.evidence.hashes) if model.evidence else None
        weight = model.evidence.all if model.evidence else None
        for batch in batches:
            for lo, hi, codes, doc, rates in _read(batch.column(2).to_pylist()):
                s = model.score(vectors(codes, doc, rates, lookup, weight))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(s, pa.float64())],
                    ["doc_id", "source", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, source string, score double")


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, flagged, rate): sources are told apart without regard to case and outer blanks."""
    source = F.lower(F.trim("source")).alias("source")
    out = scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged")
    )
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))
