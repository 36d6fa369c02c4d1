"""Toxic passages by maximum-scoring segments.

A model is learnt from labelled documents.  Every word stands for three units: the
word, and its first five and first four letters, so that inflected forms share
evidence.  A unit's log-odds compare how often documents of either label hold it,
under a Dirichlet prior of ``PRIOR`` per unit and of ``STRENGTH`` documents spread
like the whole sample; a token takes the log-odds of its most significant unit, or
nothing if none reaches ``Z``.  Every token costs ``DRIFT``, so random text drifts
down, and one linear scan over a text finds all its maximal segments of positive
score.

Scores of segments in clean text fall off exponentially; their rate and density
are fitted from clean training documents.  They give each segment an expected
number of equally good segments in a clean text of that length: segments with at
most ``EXPECTED`` are reported.  A document's evidence is the sum of its segments'
``-log`` expectations, and a logistic curve on it gives the score.  Training
documents are scored without their own counts when the curve is fitted.

The fit reads at most ``FIT_ROWS`` labelled documents, those of least hash; this
bounds the model, which every task receives.  Scoring reads every row and whole
texts.  Null and empty texts have no segments and get the curve's lowest score.
Labels that are repeated count once, toxic if any says so; null labels are ignored.
With no labels, or labels of one kind, no unit is significant and every score is
the smoothed share of toxic labels.  Repeated rows score alike; an empty table
gives an empty result; ``with_scores`` carries all columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages

PRIOR = 0.5
STRENGTH = 10.0
Z = 3.0
PREFIXES = (5, 4)
DRIFT = 0.25
EXPECTED = 0.01
FIT_ROWS = 50_000
THRESHOLD = 0.7
PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"
_WORD = re.compile(r"\w+")
_CACHE = 300_000


def units(word: str) -> tuple[str, ...]:
    """The units of a lower-cased word; prefixes carry a mark."""
    return (word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n))


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> tuple[float, float]:
    """Log-odds of a unit held by so many of the documents, and its z-score."""
    share = (toxic + clean) / max(1.0, n_toxic + n_clean)
    a = PRIOR + STRENGTH * share
    y1, y0 = toxic + a, clean + a
    total = STRENGTH + 2 * PRIOR
    rest1, rest0 = max(n_toxic + total - y1, PRIOR), max(n_clean + total - y0, PRIOR)
    delta = math.log(y1 / rest1) - math.log(y0 / rest0)
    return delta, delta / math.sqrt(1 / y1 + 1 / y0)


def segments(tokens: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal segments ``(first token, last token, score)`` of a sequence in
    which token i scores ``s - drift`` for each (i, s) given and ``-drift`` else."""
    stack: list[tuple[float, float, int, int, int]] = []  # before, after, first, last, nearest lower segment
    gained = 0.0
    for at, score in tokens:
        before = gained - drift * at
        gained += score
        after = gained - drift * (at + 1)
        if after <= before:
            continue
        first = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, first, at, j))
                break
            before, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, after - before) for before, after, first, last, _ in stack]


class _Held(dict):
    """Counts of a word's units, remembered for the words last seen; most have none."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self._prefixes = {n: {u[2:]: c for u, c in counts.items() if u.startswith(f"{n}:")} for n in PREFIXES}

    def __missing__(self, raw: str) -> tuple:
        if len(self) > _CACHE:
            self.clear()
        word = raw.lower()
        found = [self.counts.get(word), *(held.get(word[:n]) for n, held in self._prefixes.items())]
        held = self[raw] = tuple(c for c in found if c)
        return held

    def __reduce__(self):
        return _Held, (self.counts,)


class Model:
    """Counts of units and the fitted curve; small enough to ship to every task."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        self.counts, self.n_toxic, self.n_clean = counts, n_toxic, n_clean
        self.rate, self.density = 1.0, 1e-6
        self.a, self.b = math.log((n_toxic + 0.5) / (n_clean + 0.5)), 0.0
        self._held = _Held(counts)

    def token_score(self, held: tuple, own: int | None = None) -> float:
        """Log-odds of a word with these units' counts; ``own`` is the label of a
        document to leave out."""
        best, certain, n1, n0 = 0.0, Z, self.n_toxic, self.n_clean
        if own is not None:
            n1, n0 = n1 - own, n0 - 1 + own
        for t, c in held:
            if own is not None:
                t, c = max(0, t - own), max(0, c - 1 + own)
            delta, z = log_odds(t, c, n1, n0)
            if abs(z) >= certain:
                best, certain = delta, abs(z)
        return best

    def scan(self, text: str, own: int | None = None):
        """Segments of a text as (first character, end, score), and its number of tokens."""
        held = [self._held[word] for word in _WORD.findall(text)]
        memo: dict[tuple, float] = {}
        hits = []
        for at, counts in enumerate(held):
            if counts:
                score = memo.get(counts)
                if score is None:
                    score = memo[counts] = self.token_score(counts, own)
                if score:
                    hits.append((at, score))
        found = segments(hits)
        if not found:
            return [], len(held)
        wanted = {at for first, last, _ in found for at in (first, last)}
        where = {at: match.span() for at, match in enumerate(_WORD.finditer(text)) if at in wanted}
        return [(where[first][0], where[last][1], score) for first, last, score in found], len(held)

    def expected(self, score: float, n: int) -> float:
        return self.density * max(n, 1) * math.exp(-min(self.rate * score, 700.0))

    def evidence(self, found: list, n: int) -> float:
        """log(1 + sum of -log expectations); weak segments still order texts a little."""
        total = sum(math.log1p(1 / self.expected(s, n)) for _, _, s in found)
        return math.log1p(total)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.a + self.b * evidence))))


def _logistic(rows: list[tuple[float, int, int]], a: float) -> tuple[float, float]:
    """a, b of P = 1/(1+exp(-(a+b x))) for rows (x, toxic, count), b >= 0, with a
    weak pull towards b = 0; damped Newton steps."""
    b = 0.0
    for _ in range(100):
        g0, g1, h00, h01, h11 = 0.0, -0.01 * b, 1e-9, 0.0, 0.01
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * x))))
            w = n * p * (1 - p)
            g0, g1 = g0 + n * (y - p), g1 + n * (y - p) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        da, db = max(-1.0, min(1.0, da)), max(-1.0, min(1.0, db))
        a, b = a + da, max(0.0, b + db)
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per unit of a whole task where they fit, so little is shuffled."""
    def rows(held):
        keys = list(held[0] | held[1])
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.string()), pa.array([held[1][k] for k in keys], pa.int64()),
            pa.array([held[0][k] for k in keys], pa.int64()),
        ], ["unit", "toxic", "clean"])

    held = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = {w.lower() for w in set(_WORD.findall(text.as_py() or ""))}
            into = held[bool(toxic.as_py())]
            into.update(words)
            for n in PREFIXES:
                into.update([f"{n}:{p}" for p in {w[:n] for w in words} if len(p) == n])
        if len(held[0]) + len(held[1]) > _CACHE:
            yield rows(held)
            held = (Counter(), Counter())
    yield rows(held)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """A model from the labelled documents that are not held out."""
    spark = docs.sparkSession
    stages = Stages(spark)
    marked = (
        labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # at most fit_rows ids and flags
    rows = stages.write(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(marked), "doc_id").select("text", "toxic")
    )
    n = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = int(n[0] or 0), int(n[1] or 0)
    counts = (
        rows.mapInArrow(_unit_rows, "unit string, toxic long, clean long")
        .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # what cannot reach Z even by the least prior never leaves the executors
    share = (F.col("toxic") + F.col("clean")) / max(1, n_toxic + n_clean)
    a = F.lit(PRIOR) + F.lit(STRENGTH) * share
    y1, y0, total = F.col("toxic") + a, F.col("clean") + a, STRENGTH + 2 * PRIOR
    delta = F.log(y1 / F.greatest(F.lit(n_toxic + total) - y1, F.lit(PRIOR))) - F.log(
        y0 / F.greatest(F.lit(n_clean + total) - y0, F.lit(PRIOR))
    )
    strong = counts.filter(F.abs(delta) / F.sqrt(1 / y1 + 1 / y0) >= Z - 1e-9)
    model = Model({r[0]: (r[1], r[2]) for r in strong.collect()}, n_toxic, n_clean)
    if n_toxic and n_clean:
        _calibrate(rows, model)
    stages.close()
    return model


def _calibrate(rows: DataFrame, model: Model) -> None:
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, lengths = [], []
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found, n = shipped.value.scan(text.as_py(), int(toxic.as_py()))
                scores.append([s for _, _, s in found])
                lengths.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(scores, pa.list_(pa.float64())), pa.array(lengths, pa.int64())], ["y", "scores", "n"]
            )

    stages = Stages(spark)
    found = stages.write(rows.mapInArrow(scanned, "y int, scores array<double>, n long"))
    c, s, n = found.filter("y = 0").agg(
        F.sum(F.size("scores")), F.sum(F.aggregate("scores", F.lit(0.0), lambda total, x: total + x)), F.sum("n")
    ).first()
    # half a segment of unit score more than seen, so that both stay finite
    model.rate, model.density = min(1.0, (c + 0.5) / (s + 0.5)), (c + 0.5) / max(1, n)
    expected = lambda score: F.lit(model.density) * F.greatest("n", F.lit(1)) * F.exp(-F.least(score * model.rate, F.lit(700.0)))
    evidence = F.log1p(F.aggregate("scores", F.lit(0.0), lambda total, x: total + F.log1p(1 / expected(x))))
    # evidence is a logarithm rounded to tenths: some dozens of rows
    bins = found.groupBy(F.round(evidence, 1).alias("x"), "y").agg(F.count(F.lit(1))).collect()
    model.a, model.b = _logistic([tuple(r) for r in sorted(bins)], model.a)
    stages.close()
    shipped.unpersist()


def with_scores(docs: DataFrame, model: Model, text: str = "text", prefix: str = "toxicity_") -> DataFrame:
    """All rows and columns, with ``<prefix>score`` and ``<prefix>passages`` (start
    and end in code points, score, and expected number in clean text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    names = [*docs.columns, f"{prefix}score", f"{prefix}passages"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                cut = batch.slice(begin, 512)
                scores, passages = [], []
                for value in cut.column(at):
                    found, n = shipped.value.scan(value.as_py() or "")
                    scores.append(shipped.value.score(shipped.value.evidence(found, n)))
                    spans = [{"start": f, "end": e, "score": s, "expected": shipped.value.expected(s, n)} for f, e, s in found]
                    passages.append([p for p in spans if p["expected"] <= EXPECTED])
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names
                )

    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{prefix}score` double, `{prefix}passages` {PASSAGES}")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` for every row."""
    model = fit(docs, labels, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_scores(rows, model, "text", "").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages",
    )
