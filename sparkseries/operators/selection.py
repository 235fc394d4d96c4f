"""Members are checked, searched, trained out of fold, blended and ranked on the same rows; the best is chosen."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ensembles import cross_fit_by_metric, join_members, mean_blend, rank_mean_blend, stack
from .metrics import get_metric, score_by
from .models import leaderboard, make_pipeline, model_factory, run_cv, tune_by_folds
from .ranges import written
from .ridge import ridge_cv, search_predictions

METHODS = ("mean", "weighted", "rank_mean", "stacking")


@dataclass(frozen=True)
class Member:
    """One model of a selection: ``oof(df, params)`` gives ``key, fold, target, pred`` of a table whose folds are in ``fold``.

    ``data`` names the table it is for. With a ``space`` (``models.sample_space``) its parameters are searched first, in ``trials`` trials: all trials of a fold together where there is
    ``several(df)``, which gives a function from a list of parameters and a fold to ``trial, target, pred``, the fold's rows predicted with each, else each by ``oof``.
    """

    name: str
    oof: Callable[[DataFrame, dict], DataFrame]
    task: str = "regression"
    target: str = "y"
    key: str = "key"
    fold: str = "fold"
    metric: str = "rmse"
    data: str = ""
    params: Mapping[str, object] = field(default_factory=dict)
    space: Mapping[str, tuple] = field(default_factory=dict)
    trials: int = 8
    several: Callable[[DataFrame], Callable[[Sequence[dict], int], DataFrame]] | None = None

    @property
    def shared(self) -> dict[str, object]:
        """What all members of a selection have in common."""
        return {n: getattr(self, n) for n in ("data", "task", "target", "key", "fold", "metric")}


def ridge_member(name: str, features: Sequence[str], **options) -> Member:
    """A ridge by second moments; parameter ``reg``."""
    target, key, fold = (options.get(n, d) for n, d in (("target", "y"), ("key", "key"), ("fold", "fold")))
    penalty = lambda params: float(params.get("reg", 0.0))

    def several(df: DataFrame) -> Callable[[Sequence[dict], int], DataFrame]:
        predicted = search_predictions(df, features, target, fold)
        return lambda points, k: predicted([penalty(p) for p in points], k)

    return Member(name, lambda df, params: ridge_cv(df, features, target, key, fold, penalty(params))[0], several=several, **options)


def model_member(name: str, kind: str, features: Sequence[str], **options) -> Member:
    """Any model of ``models.model_factory`` for values or two classes; parameters are the model's own."""
    task, target, key, fold = (options.get(n, d) for n, d in (("task", "regression"), ("target", "y"), ("key", "key"), ("fold", "fold")))
    return Member(name, lambda df, params: run_cv(df, make_pipeline(model_factory(kind, task, target, **params), features), task, key, target, fold)[0], **options)


def check_members(members: Sequence[Member], methods: Sequence[str] = ("mean",)) -> None:
    """An error before anything is trained: repeated names, members that differ in data, folds, task, target or metric, a metric or a method that is not for the task."""
    if not members:
        raise ValueError("no members")
    names = [m.name for m in members]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"members share names: {twice}")
    for m in members[1:]:
        if wrong := sorted(n for n, v in members[0].shared.items() if m.shared[n] != v):
            raise ValueError(f"{m.name} and {members[0].name} differ in {wrong}")
    first = members[0]
    if first.task == "multiclass":
        raise ValueError("blends are of one column of predictions: values, or probabilities of two classes")
    get_metric(first.metric, first.task)
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"{unknown} are none of {METHODS}")
    if "rank_mean" in methods and first.task != "binary":
        raise ValueError("mean ranks are for two classes only")
    if "stacking" in methods and first.task == "binary":
        raise ValueError("stacking is by a linear model of values")


def searched(df: DataFrame, member: Member, seed: int = 0) -> tuple[dict, list[dict]]:
    """The best parameters of a member and its trials: one fold of the table after another is held out, and trials under the median of the others stop. The table is written once."""
    df = written(df)
    folds = sorted(r[0] for r in df.select(member.fold).distinct().collect() if r[0] is not None and r[0] >= 0)

    def objective(params: dict, fold: int) -> float:
        # two folds, of which the others' rows only train
        split = df.withColumn(member.fold, F.when(F.col(member.fold) == fold, 0).otherwise(-1))
        out = member.oof(split, {**member.params, **params}).filter(F.col(member.fold) == 0)
        return score_by(out, member.target, "pred", member.metric, [member.fold]).first()["score"]

    predicted = member.several(df) if member.several else None

    def together(points: Sequence[dict], fold: int) -> list[float]:
        out = predicted([{**member.params, **p} for p in points], fold)
        found = {r["trial"]: r["score"] for r in score_by(out, member.target, "pred", member.metric, ["trial"]).collect()}
        return [found[t] for t in range(len(points))]

    best, rows = tune_by_folds(together if predicted else objective, member.space, member.trials, folds, get_metric(member.metric)[0].greater, seed, together=predicted is not None)
    return {**member.params, **best}, rows


@dataclass
class Selection:
    """``summary``: ``kind, name, score, rank, chosen``; ``predictions``: key, fold, target, a column for each member and blend; ``params`` and ``trials`` by member."""

    summary: DataFrame
    predictions: DataFrame
    params: dict[str, dict]
    trials: dict[str, list[dict]]
    chosen: str


def select_model(df: DataFrame, members: Sequence[Member], methods: Sequence[str] = ("mean", "weighted"), seed: int = 0, reg: float = 0.0) -> Selection:
    """Members with a space are searched, all are trained out of fold, and their predictions are blended in each way: ``mean``; ``weighted``, by weights that are best by the metric on the
    other folds; ``rank_mean`` (two classes); ``stacking``, a ridge on the predictions. Members and blends are scored on the same rows, those that all members predict, and ranked by the members' metric (equal
    scores share the better rank); the first of the best, members before blends in the order given, is chosen. One member is not blended.

    Members are checked first (``check_members``). Predictions are written once each.
    """
    check_members(members, methods)
    first, params, trials = members[0], {}, {}
    names = [m.name for m in members]
    for m in members:
        params[m.name], trials[m.name] = searched(df, m, seed) if m.space else (dict(m.params), [])
    made = {m.name: written(m.oof(df, params[m.name])) for m in members}
    rows = join_members(made, first.key, (first.target, first.fold)).filter(F.col(first.fold) >= 0)
    for n in names:
        rows = rows.filter(F.col(n).isNotNull())
    kinds = [("member", n) for n in names]
    if len(members) > 1:
        for method in methods:
            if method == "mean":
                rows = rows.withColumn(method, mean_blend(names))
            elif method == "weighted":
                rows = cross_fit_by_metric(rows, names, first.target, first.fold, first.metric, method)
            elif method == "rank_mean":
                rows = rank_mean_blend(rows, names, method)
            else:
                stacked = stack(rows, names, first.target, first.key, first.fold, reg).select(first.key, F.col("pred").alias(method))
                rows = rows.join(stacked, first.key)
            kinds.append(("blend", method))
        rows = written(rows)
    long = rows.select(first.target, *[n for _, n in kinds]).unpivot([first.target], [n for _, n in kinds], "name", "_p")
    found = {r["name"]: r["score"] for r in score_by(long, first.target, "_p", first.metric, ["name"]).collect()}
    table = df.sparkSession.createDataFrame([(i, k, n, found.get(n)) for i, (k, n) in enumerate(kinds)], "_i int, kind string, name string, score double")
    ranked = leaderboard(table, "score", get_metric(first.metric)[0].greater)
    chosen = ranked.orderBy("rank", "_i").first()["name"]
    return Selection(ranked.withColumn("chosen", F.col("name") == chosen).drop("_i"), rows, params, trials, chosen)
