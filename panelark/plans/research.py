"""End-to-end jobs: feature matrix, research run, training and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelark.functions.skew import checked_once, dealt, is_balanced
from panelark.operators import backtest, cross_asset, drift, ic, models, quality, selection, sentiment
from panelark.operators.folds import holdout_split
from panelark.operators.price import price_features
from panelark.operators.rows import complete_rows, latest_session, sanitize
from panelark.operators.weights import cash_weights
from panelark.schema import BENCH_COL, ONE_WAY_BPS, TARGET
from panelark.session import cut_lineage, written
from panelark.sources.bundle import Bundle, Metadata

COMPARED = ["ic", "t_stat", "sharpe", "dsr_41", "dsr_100", "dsr_200", "max_drawdown", "turnover"]


def feature_matrix(bars: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """Bars to bars plus all features, label and sector-neutral label.

    The steps keep the rows of ``bars``, so the symbols are checked for hot ones
    only once, and dealt over enough tasks for the columns that are added.
    """

    def build() -> DataFrame:
        # a hot symbol is cut into slices, which bars dealt by symbol would bring together again
        df = price_features(dealt(bars, ["symbol"]) if is_balanced(["symbol"]) else bars)
        df = cross_asset.cross_asset_features(df, BENCH_COL)
        return sentiment.headline_features(sentiment.sentiment_features(df))

    df = checked_once(bars, ["symbol"], "timestamp", build)
    df = cross_asset.sector_neutral(cross_asset.tag_sectors(df, sectors))
    return sanitize(df, selection.candidate_features(df))


@dataclass
class ResearchResult:
    """Result tables by name, and the names chosen on the way."""

    tables: dict[str, DataFrame]
    candidates: list[str]
    accepted: list[str]
    selected: list[str]


def signal_columns(df: DataFrame, predictions: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """Rule signals and model predictions in columns of a written table, and their names; unpredicted dates get 0."""
    rows = df.select(*[c for c in ("timestamp", "symbol", "open", TARGET, "return_5d", "return_60d", "momentum_12_1") if c in df.columns])
    for name, scored in predictions.items():
        own = scored.select(F.col("timestamp").alias("timestamp"), F.col("symbol").alias("symbol"), F.col("prediction").alias(name))
        rows = rows.join(own, ["timestamp", "symbol"], "left")
    filled = [F.coalesce(name, F.lit(0.0)).alias(name) for name in predictions]
    return written(backtest.rule_columns(rows, filled), "signals"), [*backtest.RULES, *predictions]


def run_research(
    bars: DataFrame,
    sectors: DataFrame | None = None,
    reference: DataFrame | None = None,
    splits: int = 5,
    top_k: int = 15,
    cost_bps: float = ONE_WAY_BPS,
    trials: tuple[int, ...] = (41, 100, 200),
) -> ResearchResult:
    """Features, gates, selection, walk-forward comparison, holdout, ablation and drift."""
    df = cut_lineage(feature_matrix(bars, sectors))
    candidates = selection.candidate_features(df)
    gate = cut_lineage(quality.quality_gate(df, candidates))
    accepted = [r["feature"] for r in gate.where("reason IS NULL").orderBy("place").collect()]

    evaluation = selection.evaluate_features(df, accepted, models.tree_importance(df, accepted))
    ranked = [
        r["feature"] for r in selection.shortlist(evaluation).orderBy(F.desc("score"), "feature").select("feature").collect()
    ]
    selected = selection.prune_redundant(df, ranked, top_k=top_k) or accepted[:top_k]

    parts = cut_lineage(holdout_split(df))
    validation = cut_lineage(df.join(parts.where("part = 'validation'").select("timestamp"), "timestamp", "left_semi"))
    held = df.join(parts.where("part = 'holdout'").select("timestamp"), "timestamp", "left_semi")

    base = models.walk_forward(validation, [c for c in models.BASELINE_FEATURES if c in df.columns], splits=splits)
    full, chosen = models.nested_walk_forward(validation, accepted, splits, top_k=top_k)
    plain = selection.without_sentiment(accepted)
    ablated, _ = models.nested_walk_forward(validation, plain, splits, top_k=top_k)
    full = cut_lineage(full)
    predictions = {"prediction_ohlcv": base, "prediction_full": full, "prediction_ablated": ablated}
    columns, names = signal_columns(validation, predictions)
    signals = backtest.long_signals(columns, names)

    daily = ic.feature_rank_ic(columns, names).withColumnRenamed("feature", "strategy")
    inference = cut_lineage(ic.ic_inference(daily, ["strategy"]))
    periods = backtest.panel_periods(signals, stored=True)
    net = backtest.net_returns(periods, cost_bps)
    performance = cut_lineage(backtest.deflated_sharpe(backtest.performance(net), trials))
    strategies = [
        "eq_weight_signal", "mom_12_1_signal", "reversal_5d_signal", "reversal_lowturnover_signal", "prediction_ohlcv",
        "prediction_full",
    ]
    metrics = [m for m in COMPARED if m in performance.columns or m in ("ic", "t_stat")]
    table = performance.join(inference.select("strategy", "ic", "t_stat"), "strategy", "left")
    versus = [(s, "eq_weight_signal") for s in ("prediction_full", "reversal_5d_signal", "reversal_lowturnover_signal")]

    tables = {
        "quality": gate,
        "evaluation": evaluation,
        "comparison": backtest.comparison_table(table, strategies, metrics),
        "ic_inference": inference,
        "performance": performance,
        "cost_sensitivity": backtest.cost_table(backtest.cost_sweep(periods), strategies),
        "sharpe_difference": backtest.compare_sharpe(net, versus),
        "fold_metrics": models.fold_metrics(full),
        "pooled_metrics": models.pooled_metrics(full),
        "ic_by_year": ic.ic_by_year(ic.daily_rank_ic(full, "prediction")),
        "holdout": holdout_evaluation(validation, held, accepted, top_k, cost_bps),
        "ablation": table.where(F.col("strategy").isin("prediction_full", "prediction_ablated")).select(
            "strategy", "ic", "sharpe"
        ),
        "fold_features": _named(df, chosen),
        "net_returns": net,
    }
    if reference is not None:
        tables["drift"] = drift.drift_table(reference, df, selected)
    return ResearchResult(tables, candidates, accepted, selected)


def _named(df: DataFrame, chosen: dict[int, list[str]]) -> DataFrame:
    rows = [(fold, i, name) for fold, names in chosen.items() for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "fold int, place int, feature string")


def holdout_evaluation(
    validation: DataFrame, held: DataFrame, features: list[str], top_k: int = 15, cost_bps: float = ONE_WAY_BPS
) -> DataFrame:
    """Select and fit on the validation part, evaluate once on the holdout part."""
    importance = models.tree_importance(validation, features)
    names = selection.select_features(validation, features, top_k=top_k, importance=importance) or features[:top_k]
    scored = cut_lineage(
        models.predict(models.fit(validation, names), held, names).select(
            "timestamp", "symbol", "open", TARGET, F.col("prediction").alias("prediction_full"), F.lit(1.0).alias("eq_weight_signal")
        )
    )
    rows = backtest.long_signals(scored, ["prediction_full", "eq_weight_signal"])
    stats = backtest.performance(backtest.net_returns(backtest.panel_periods(rows), cost_bps))
    mean_ic = ic.daily_rank_ic(scored, "prediction_full").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic")).scalar()
    span = scored.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return stats.select(
        "strategy",
        span.select("a").scalar().alias("holdout_start"),
        span.select("b").scalar().alias("holdout_end"),
        F.when(F.col("strategy") == "prediction_full", mean_ic).alias("ic"),
        "sharpe",
        "max_drawdown",
        "turnover",
    )


def train_model(features: DataFrame, selected: list[str], max_names: int = 5, max_weight: float = 0.30) -> Bundle:
    """Fit on labelled rows and freeze the model with the value counts of all of them."""
    if not selected:
        raise ValueError("no features selected")
    labelled = complete_rows(features, [TARGET])
    last = labelled.agg(F.max("timestamp")).first()[0]
    if last is None:
        raise ValueError("no labelled rows")
    model = models.fit(labelled, selected)
    meta = Metadata(feature_cols=list(selected), train_end=str(last), max_names=max_names, max_weight=max_weight)
    return Bundle(model, meta, drift.value_counts(labelled, selected))


def score_universe(features: DataFrame, bundle: Bundle, held: DataFrame | None = None, days: int = 60) -> dict[str, DataFrame]:
    """Score the latest session with a frozen model: signals, drift reports and drift gate."""
    names = bundle.meta.feature_cols
    scored = models.predict(bundle.model, latest_session(features), names)
    weighted = cash_weights(
        scored,
        max_names=bundle.meta.max_names,
        max_weight=bundle.meta.max_weight,
        gross=bundle.meta.gross_exposure,
        held=held,
    )
    signals = weighted.select(
        F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("signal_date"),
        "symbol", "open", "high", "low", "close", "volume", "prediction", "weight",
        F.lit(bundle.meta.execution).alias("execution"),
    )
    window = drift.value_counts(drift.evaluation_window(features, days), names)
    both = cut_lineage(drift.paired(bundle.reference.where(F.col("feature").isin(names)), window))
    return {
        "signals": signals,
        "drift": drift.drift_report(both),
        "gate": drift.gate_of(both),
    }

