"""Quality metrics: word and diarization error, overlap, purity, scorecards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import contains_idea, declines, tokens
from parlance.operators.segmentation import runs

M = "meeting_id"
STEP = 0.01  # seconds of a frame
COLLAR = 0.25
WER = T.StructType([T.StructField("wer", T.DoubleType()), *(T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions", "reference_words"))])


def align(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest alignment; on ties a substitution, then a deletion.

    A row of the table at a time in NumPy: for the cells of a row the cost through insertions is a running minimum of
    cost - column. Counts are packed beside the cost (cost, then the preference) so that ties fall as stated.
    """
    names: dict[str, int] = {}
    ref = np.array([names.setdefault(w, len(names)) for w in reference], dtype=np.int64)
    hyp = np.array([names.setdefault(w, len(names)) for w in hypothesis], dtype=np.int64)
    m = len(hyp)
    cost, sub, gone = np.arange(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    column = np.arange(m + 1)
    for i, word in enumerate(ref, 1):
        equal = hyp == word
        diagonal, above = cost[:-1] + ~equal, cost[1:] + 1
        free = np.concatenate([[i], np.minimum(diagonal, above)])
        new = np.minimum.accumulate(free - column) + column
        # Where each cell comes from: an equal word always takes the diagonal, else substitution, deletion, insertion.
        via_diagonal = np.concatenate([[False], equal | (diagonal == new[1:])])
        via_above = np.concatenate([[True], ~via_diagonal[1:] & (above == new[1:])])
        new[1:][equal] = cost[:-1][equal]
        s = np.where(via_diagonal, np.concatenate([[0], sub[:-1] + ~equal]), np.where(via_above, sub, 0))
        g = np.where(via_diagonal, np.concatenate([[0], gone[:-1]]), np.where(via_above, gone + 1, 0))
        start = np.maximum.accumulate(np.where(via_diagonal | via_above, column, 0))  # an insertion inherits from its left
        cost, sub, gone = new, s[start], g[start]
    s, g = int(sub[m]), int(gone[m])
    return s, g, int(cost[m]) - s - g


@F.pandas_udf(WER)
def word_error(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for ref, hyp in zip(reference, hypothesis, strict=True):
        s, d, i = align(list(ref), list(hyp))
        rows.append(((s + d + i) / len(ref) if len(ref) else 0.0, s, d, i, len(ref)))
    return pd.DataFrame(rows, columns=WER.names)


def wer(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds wer, substitutions, deletions, insertions, reference_words to pairs of texts."""
    return pairs.withColumn("we", word_error(tokens(F.col(reference)), tokens(F.col(hypothesis)))).select(*pairs.columns, "we.*")


def assign(overlap: np.ndarray) -> dict[int, int]:
    """Column -> row, one to one, of the largest total: shortest augmenting paths with potentials on a padded square."""
    n = max(overlap.shape) if overlap.size else 0
    cost = np.zeros((n, n))
    cost[: overlap.shape[0], : overlap.shape[1]] = -overlap
    rows, columns = np.zeros(n), np.zeros(n)  # potentials
    owner = np.full(n, -1)  # row of each column
    for start in range(n):
        row, used, came = start, np.zeros(n, bool), np.full(n, -1)
        least = np.full(n, np.inf)
        column = -1
        while row >= 0:
            if column >= 0:
                used[column] = True
            slack = cost[row] - rows[row] - columns
            closer = ~used & (slack < least)
            least[closer], came[closer] = slack[closer], column
            nearest = int(np.argmin(np.where(used, np.inf, least)))
            step = least[nearest]
            rows[start] += step
            rows[owner[used]] += step
            columns[used] -= step
            least[~used] -= step
            column, row = nearest, owner[nearest]
        while column >= 0:  # along the path every column takes the row of the one before it
            before = came[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    return {c: int(r) for c, r in enumerate(owner) if c < overlap.shape[1] and 0 <= r < overlap.shape[0]}


def _frames(turns: DataFrame, step: float) -> DataFrame:
    """Turns with the first of their frames and the one after their last."""
    rows = turns.withColumn("f", F.greatest(F.lit(0), (F.col("start") / step).cast("long"))).withColumn("l", F.ceil(F.col("end") / step))
    return rows.where("l > f")


def speaker_frames(reference: DataFrame, hypothesis: DataFrame, collar: float = COLLAR, step: float = STEP) -> DataFrame:
    """(meeting_id, r, h, n): frames in which r speaks in the reference and h in the hypothesis (null: nobody).

    No frames are made. A meeting's edges cut its time into pieces in which nothing changes; each turn is laid over the
    pieces it covers, a later turn (`ordinal`) wins a piece, and pieces count by their width. Pieces within the collar of a
    reference edge are left out.
    """
    ref, hyp = _frames(reference, step), _frames(hypothesis, step)
    c = int(collar / step)
    edge = reference.select(M, F.explode(F.array("start", "end")).alias("t")).select(M, (F.col("t") / step).cast("long").alias("e"))
    near = edge.select(M, (F.col("e") - c).alias("f"), (F.col("e") + c + 1).alias("l")) if collar > 0 else None
    ends = [rows.select(M, F.explode(F.array("f", "l")).alias("at")) for rows in (ref, hyp, near) if rows is not None]
    cuts = ends[0]
    for more in ends[1:]:
        cuts = cuts.union(more)
    cuts = cuts.groupBy(M).agg(F.array_sort(F.collect_set("at")).alias("cuts"))

    def pieces(rows: DataFrame, *columns: str) -> DataFrame:
        inside = F.filter("cuts", lambda x: (x >= F.col("f")) & (x < F.col("l")))
        return rows.join(cuts, M).select(M, *columns, F.explode(inside).alias("at"))

    who = lambda rows, name: pieces(rows, "ordinal", "speaker").groupBy(M, "at").agg(F.max_by("speaker", "ordinal").alias(name))
    rows = who(ref, "r").join(who(hyp, "h"), [M, "at"], "full")
    if near is not None:
        rows = rows.join(pieces(near).distinct(), [M, "at"], "left_anti")
    after = F.try_element_at("cuts", (F.array_position("cuts", F.col("at")) + 1).cast("int"))
    return rows.join(cuts, M).withColumn("n", after - F.col("at")).groupBy(M, "r", "h").agg(F.sum("n").alias("n"))


def der(reference: DataFrame, hypothesis: DataFrame, collar: float = COLLAR, step: float = STEP) -> DataFrame:
    """(meeting_id, der, missed, false_alarm, confusion, total) in seconds, from turns (meeting_id, ordinal, start, end, speaker).

    Only the small speaker-by-speaker table of each meeting goes to Python for the one-to-one mapping.
    """

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        refs, hyps = sorted(pdf["r"].dropna().unique()), sorted(pdf["h"].dropna().unique())
        table = np.zeros((len(refs), len(hyps)))
        both = pdf.dropna(subset=["r", "h"])
        for r, h, n in zip(both["r"], both["h"], both["n"], strict=True):
            table[refs.index(r), hyps.index(h)] += n
        right = sum(table[r, h] for h, r in assign(table).items())
        miss, false = float(pdf["n"][pdf["h"].isna()].sum()), float(pdf["n"][pdf["r"].isna()].sum())
        total, wrong = float(pdf["n"][pdf["r"].notna()].sum()), float(both["n"].sum()) - right
        return pd.DataFrame({M: [pdf[M].iloc[0]], "der": [(miss + false + wrong) / total if total else 0.0], "missed": [miss * step], "false_alarm": [false * step], "confusion": [wrong * step], "total": [total * step]})

    counts = speaker_frames(reference, hypothesis, collar, step)
    return counts.groupBy(M).applyInPandas(score, f"{M} {dict(reference.dtypes)[M]}, der double, missed double, false_alarm double, confusion double, total double")


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """(keys, a_id, b_id, seconds) of intervals that overlap. Both sides are dealt into time buckets, so a key's intervals
    meet only where they are near; a pair counts in the bucket of its overlap's start."""
    cut = lambda rows, name: rows.select(*keys, F.col("id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end")).withColumn("io__b", F.explode(F.sequence(F.floor(F.col(f"{name}_start") / bucket), F.floor(F.col(f"{name}_end") / bucket))))
    rows = cut(a, "a").join(cut(b, "b"), [*keys, "io__b"]).where("a_start < b_end and b_start < a_end")
    begin = F.greatest("a_start", "b_start")
    rows = rows.where(F.floor(begin / bucket) == F.col("io__b"))
    return rows.select(*keys, "a_id", "b_id", (F.least("a_end", "b_end") - begin).alias("seconds"))


def chunk_purity(overlaps: DataFrame, keys: list[str], pure: float = 0.9) -> DataFrame:
    """(keys, a_id, speaker, share, is_pure): the speaker with most of each chunk's overlap (b_speaker, seconds)."""
    by = overlaps.groupBy(*keys, "a_id", "b_speaker").agg(F.sum("seconds").alias("s"))
    rows = by.groupBy(*keys, "a_id").agg(F.max(F.struct("s", "b_speaker")).alias("top"), F.sum("s").alias("total"))
    share = F.col("top.s") / F.col("total")
    return rows.select(*keys, "a_id", F.col("top.b_speaker").alias("speaker"), share.alias("share"), (share >= pure).alias("is_pure"))


def scorecard(checks: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    return checks.groupBy(*keys).agg(F.count_if(passed).alias("n_passed"), F.count(F.lit(1)).alias("n_checks"))


def trial_tally(trials: DataFrame) -> DataFrame:
    """(backend, check, n_passed, n_runs, n_outputs) of (backend, run, check, passed, output)."""
    return trials.groupBy("backend", "check").agg(F.count_if("passed").alias("n_passed"), F.countDistinct("run").alias("n_runs"), F.countDistinct("output").alias("n_outputs"))


def match_expected(expected: DataFrame, reported: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Each expected phrase (meeting_id, exp_id, phrase) with the first reported text (rep_id, text) that contains its idea;
    a declined one does not count for a phrase that isn't. Joined by meeting: answer keys are short lists."""
    rows = expected.join(reported, M).where(contains_idea(F.col("text"), F.col("phrase"), threshold) & (declines(F.col("text")) == declines(F.col("phrase"))))
    best = rows.groupBy(M, "exp_id").agg(F.min("rep_id").alias("rep_id"))
    return expected.join(best, [M, "exp_id"], "left").withColumn("found", F.col("rep_id").isNotNull())


def recovery(corruptions: DataFrame, refined: DataFrame) -> DataFrame:
    """(meeting_id, n_injected, n_occurred, n_recovered) of injected corruptions (meeting_id, term, occurred) against the
    refined text: both denominators, the terms given and those that occurred."""
    rows = corruptions.join(refined.groupBy(M).agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("all")), M, "left")
    ok = F.col("occurred") & F.contains(F.col("all"), F.lower("term"))
    return rows.groupBy(M).agg(F.count(F.lit(1)).alias("n_injected"), F.count_if("occurred").alias("n_occurred"), F.count_if(ok).alias("n_recovered"))


def frame_sweep(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds in which two labellings agree, differ, or one is silent, by a sweep over their edges: no frames are made.

    a, b: (keys, start, end, label), each without overlaps of its own.
    """
    edges = lambda rows, side: rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.col("label").alias("l"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.col("label").alias("l"), F.lit(-1).alias("d")))).alias("e"), F.lit(side).alias("side")).select(*keys, "side", "e.t", "e.l", "e.d")
    rows = edges(a, "a").unionByName(edges(b, "b"))
    order = Window.partitionBy(*keys).orderBy("t", "d")
    span = order.rowsBetween(Window.unboundedPreceding, 0)
    for side in ("a", "b"):
        mine = F.col("side") == side
        rows = rows.withColumn(f"n_{side}", F.sum(F.when(mine, F.col("d")).otherwise(0)).over(span))
        rows = rows.withColumn(f"l_{side}", F.last(F.when(mine & (F.col("d") == 1), F.col("l")), ignorenulls=True).over(span))
    rows = rows.withColumn("len", F.lead("t").over(order) - F.col("t")).where("len > 0")
    a_on, b_on = F.col("n_a") > 0, F.col("n_b") > 0
    kind = F.when(a_on & b_on, F.when(F.col("l_a") == F.col("l_b"), "agree").otherwise("confusion")).when(a_on, "missed").when(b_on, "false_alarm")
    return rows.withColumn("kind", kind).where("kind is not null").groupBy(*keys, "kind").agg(F.sum("len").alias("seconds"))


__all__ = ["align", "assign", "chunk_purity", "der", "frame_sweep", "interval_overlap", "match_expected", "recovery", "runs", "scorecard", "speaker_frames", "trial_tally", "wer", "word_error"]
