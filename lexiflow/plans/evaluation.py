"""Three-system evaluation (the reference's final comparison) as one plan.

pairs -> drop failed rows -> positional split -> fit the corrector on the
training references -> correct every hypothesis -> row WER of both -> join the second
system on the path key -> its row WER -> one row per (row, system) -> macro and micro WER per
(split, system).  Shuffles: the index pass, the corrector's word-level steps,
the rows' fixes, the path join and the final (tiny) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import correct as C
from lexiflow.operators import evaluate as ev
from lexiflow.operators import index as ix


def evaluate(pairs: DataFrame, pseudo: DataFrame, fractions=(0.6, 0.8), min_freq: int = 10,
             unique: bool = True, by_split: bool = True) -> DataFrame:
    nn = ev.drop_null(pairs, ["hyp"])
    sp = ix.positional_split(nn, ["row_id"], fractions, numbered=False)
    corr = C.fit_corrector(sp.where(F.col("split") == "train"), "ref")
    fixed = C.correct(sp, "hyp", corr, min_freq=min_freq, unique=unique)
    # A system's rows are scored as soon as they have their reference: scores, not texts, move to the join.
    fixed = ev.with_wer(ev.with_wer(fixed, "hyp", "ref", "base"), "corrected", "ref", "corrected")
    other = ev.pseudo_with_path(pseudo)
    j = ev.join_systems(other, fixed.select("path", "split", "base", "corrected", "ref"), on="path")
    u = ev.unpivot_systems(ev.with_wer(j, "beam", "ref", "beam"), ["split"], ["base", "beam", "corrected"], "system", "score")
    by = ["split", "system"] if by_split else ["system"]
    return ev.wer_report(u, by=by)
