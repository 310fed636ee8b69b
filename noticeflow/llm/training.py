"""Bounded samples of labelled documents, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import held_out

#: Sampling compares a hash of the key, below this, with a threshold.
SPACE = 1 << 30


def sample(docs: DataFrame, labels: DataFrame | None, label: str, per_label: int, seed: int, text: str = "text", key: str = "doc_id") -> list[tuple]:
    """About ``per_label`` documents of each label, outside the held-out fold: sorted (key, text, label).

    ``labels`` has key and label; None: the label is a column of ``docs``. Rows with null keys, labels or texts are no examples; of several labels of a key the
    largest counts, and of several texts the least. Rows are drawn by a hash of the key, so the same come whatever the partitioning. The bound is on their
    number: ``per_label`` expected, and never more than twice as many keys; their texts come whole, from the tasks that have them.
    """
    own = labels is None
    marked = (docs if own else labels).select(F.col(key), F.col(label).alias("__label")).where(F.col(key).isNotNull() & F.col("__label").isNotNull() & ~held_out(key))
    counts = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    if not counts:
        return []
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("__label") == value, F.lit(min(SPACE, int(SPACE * per_label / n)))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(SPACE)) < share
    ids = marked.where(drawn).groupBy(key).agg(F.max("__label").alias("__label")).limit(2 * per_label * len(counts))  # bounded: ids and labels of the sample
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(ids), key)
    rows = rows.groupBy(key).agg(F.min(text).alias("__text"), F.max("__label").alias("__label")).toArrow().to_pydict()
    return sorted(zip(rows[key], rows["__text"], rows["__label"]))
