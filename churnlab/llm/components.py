"""Connected components of a table of links, without collecting them.

Every vertex takes the smallest label among its neighbours, then the label
of its label (pointer jumping), until no label changes. The neighbours'
minimum is a partial aggregate, so a hub with a third of all links is
combined before the shuffle; joins on a hot label are left to the adaptive
skew join. Each round is stored with a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed


def forest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of links (p, q) and the smallest vertex of each one's component."""
    nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = at[: len(p)], at[len(p) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id with a link.

    ``links`` may hold either direction, repeats and self-links.
    """
    one = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    both = checkpointed(one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["id"] == near["u"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        stepped = hooked.join(jump, "new", "left").select("id", "old", F.least("new", F.coalesce("far", "new")).alias("label"))
        labels = checkpointed(stepped)
        if labels.filter("label <> old").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")
