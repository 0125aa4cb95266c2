"""Rules mined from fitted trees, and how they hold on rows that the trees have not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.functions import rules


def paths(trees, features: list[str], least_support: int = 50, least_purity: float = 0.98, most_depth: int = 4) -> list[tuple[list[rules.Condition], int, float]]:
    """(conditions, support, purity) of the attack leaves of Spark ML trees, largest support first, each rule once."""
    found: dict[tuple, tuple[int, float]] = {}

    def walk(node, above: list[rules.Condition]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            support, purity = int(node.impurityStats().rawCount()), stats[1] / max(sum(stats), 1e-300)
            if above and support >= least_support and purity >= least_purity:
                key = tuple(rules.simplify(above))
                found[key] = max(found.get(key, (0, 0.0)), (support, purity))
            return
        if len(above) < most_depth:
            name, at = features[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), [*above, (name, "<=", at)])
            walk(node.rightChild(), [*above, (name, ">", at)])

    for tree in trees:
        walk(tree._call_java("rootNode"), [])
    return sorted(([list(k), *v] for k, v in found.items()), key=lambda r: (-r[1], -r[2], r[0]))


def validate(held: DataFrame, label: str, mined: list[list[rules.Condition]], least: int = 20) -> list[dict]:
    """For each rule, from one pass over held-out rows: matches, precision, recall, false alarms; too few matches have precision 0."""
    hits = [rules.matches(c) for c in mined]
    attack = F.col(label) == 1
    counts = held.agg(F.count_if(attack).alias("all"), *[F.count_if(h).alias(f"n{k}") for k, h in enumerate(hits)], *[F.count_if(h & attack).alias(f"t{k}") for k, h in enumerate(hits)]).first()
    out = []
    for k, c in enumerate(mined):
        n, t = counts[f"n{k}"], counts[f"t{k}"]
        out.append({"conditions": c, "matches": n, "precision": t / n if n >= least else 0.0, "recall": t / counts["all"] if counts["all"] else 0.0, "false_alarms": n - t})
    return sorted(out, key=lambda r: (-r["precision"], -r["recall"], str(r["conditions"])))


def coverage(held: DataFrame, label: str, mined: list[list[rules.Condition]]) -> dict:
    """Precision and recall of all rules together."""
    hit = F.coalesce(*[F.when(rules.matches(c), True) for c in mined], F.lit(False))
    r = held.agg(F.count_if(hit).alias("n"), F.count_if(hit & (F.col(label) == 1)).alias("t"), F.count_if(F.col(label) == 1).alias("all")).first()
    return {"matches": r["n"], "precision": r["t"] / r["n"] if r["n"] else 0.0, "recall": r["t"] / r["all"] if r["all"] else 0.0}
