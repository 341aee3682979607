"""The nine requests of the library, over tables of any number of tickers."""

from __future__ import annotations

import datetime
import json
import re
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import arguments
from .functions import recurrence
from .functions.exprs import recent
from .operators import flow, levels, momentum, scans, trend, volatility, weekly
from .plans import report, scoring

GROUPS = {
    "trend": {"ema": trend.ema, "sma_direction": trend.sma_direction, "ma_distance": trend.ma_distance, "macd": trend.macd, "macd_crossover": trend.macd_crossover, "returns": trend.returns_by_window, "sma_crossover": trend.sma_crossover, "candlestick": trend.candlestick, "alignment": trend.trend_alignment},
    "momentum": {"rsi": momentum.rsi, "z_score": momentum.z_score, "percentile": momentum.close_percentile_by_window, "percentile_one": momentum.close_percentile, "streak": momentum.return_streak, "stochastic": momentum.stochastic},
    "volatility": {"bollinger_position": volatility.bollinger_position, "squeeze": volatility.bollinger_squeeze, "c2c": volatility.c2c_volatility, "atr": volatility.atr},
    "volume_flow": {"imbalance": flow.volume_imbalance, "obv": flow.obv, "ratio": flow.volume_ratio, "spikes": flow.volume_spikes, "divergence": flow.obv_divergence},
    "trade_flow": {"imbalance": flow.count_imbalance, "size": flow.trade_size_by_side},
    "value_flow": {"avg_trade_value": flow.avg_trade_value, "spike": flow.value_spike},
    "foreign_flow": {"net_value": flow.foreign_net_value, "participation": flow.foreign_participation, "room": flow.foreign_room_trend, "structural": flow.room_structural},
}
#: Windows a request may set, and which arguments of which measures they are.
PARAMS = {
    "sma_windows": {"trend.sma_direction": "windows", "trend.series": "windows"}, "ema_windows": {"trend.ema": "windows", "trend.ema_series": "windows"},
    "macd_fast": {"trend.macd": "fast", "trend.macd_series": "fast"}, "macd_slow": {"trend.macd": "slow", "trend.macd_series": "slow"}, "macd_signal": {"trend.macd": "signal", "trend.macd_series": "signal"},
    "rsi_window": {"momentum.rsi": "n", "momentum.rsi_series": "n"},
    "bollinger_window": {"volatility.bollinger_position": "n", "volatility.squeeze": "n", "volatility.series": "n"}, "bollinger_k": {"volatility.bollinger_position": "width", "volatility.series": "width"},
    "volatility_window": {"volatility.c2c": "n"}, "flow_window": {"volume_flow.imbalance": "n", "trade_flow.imbalance": "n", "foreign_flow.participation": "n", "foreign_flow.room": "n"},
    "return_windows": {"trend.returns": "windows"}, "crossover_pairs": {"trend.sma_crossover": "pairs"}, "percentile_windows": {"momentum.percentile": "windows"}, "percentile_window": {"momentum.percentile_one": "n"},
    "z_score_window": {"momentum.z_score": "n"}, "stochastic_k_window": {"momentum.stochastic": "k"}, "stochastic_d_window": {"momentum.stochastic": "d"}, "atr_window": {"volatility.atr": "n", "volatility.atr_series": "n"},
    "volume_ratio_window": {"volume_flow.ratio": "n"}, "prev_close_tolerance": {"volume_flow.obv": "tolerance", "volume_flow.series": "tolerance"},
    "trade_size_window": {"trade_flow.size": "n"}, "value_window": {"value_flow.avg_trade_value": "n", "value_flow.spike": "n"},
}
#: Measures by row, whose last points a request may ask for.
SERIES = {
    "trend": {"series": trend.sma, "ema_series": recurrence.ema_series, "macd_series": recurrence.macd_series}, "momentum": {"rsi_series": recurrence.rsi_series},
    "volatility": {"series": volatility.bollinger, "atr_series": recurrence.atr_series}, "volume_flow": {"series": flow.obv_rows},
}
#: Parameters that are shares or factors instead of windows.
FACTORS = ("bollinger_k", "prev_close_tolerance")
#: Weekly bars that the horizons' weekly part needs, and that a weekly request needs.
WEEKS, LEAST_WEEKS = 14, 10

WEEKLY = {"ema": trend.ema, "macd": trend.macd, "rsi": momentum.rsi, "direction": trend.sma_direction}
SCOPES = {"full": ("short_term", "mid_term", "long_term"), "short_term": ("short_term",), "mid_term": ("mid_term",), "long_term": ("long_term",), "levels": ()}
STRATEGIES = {"momentum_breakout": scoring.screen_momentum, "oversold_reversal": scoring.screen_oversold, "foreign_accumulation": scoring.screen_foreign}
#: Metrics that bars cannot give, and why.
REFUSED = {"adx": "not computed", "ichimoku": "not computed", "vwap": "bars hold no prices within the day", "fundamentals": "no such data", "news": "no such data"}


COUNTS = ["total_trade", "total_volume", "buy_count", "sell_count", "buy_volume", "sell_volume", "foreign_buy_volume", "foreign_sell_volume", "foreign_room"]
BARS = ", ".join(["ticker string", "date date", *[f"{c} double" for c in ("prev_close", "open", "high", "low", "close", "total_value", "foreign_buy_value", "foreign_sell_value")], *[f"{c} bigint" for c in COUNTS]])


class RequestError(ValueError):
    """A request outside of its limits."""


@dataclass
class Engine:
    """Requests over a table of daily bars, and optionally index rows and hourly bars.

    Every method returns lazy DataFrames for all tickers asked for (default: all); :meth:`run` executes them. With ``audit``, a
    folder, calls and runs are appended there as JSON lines, ``audit_every`` of them at once and the rest by :meth:`flush`;
    failing to do so never fails the call.
    """

    bars: DataFrame
    index: DataFrame | None = None
    hours: DataFrame | None = None
    audit: str | None = None
    audit_every: int = 1
    calls: list[dict] = field(default_factory=list)
    pending: list[dict] = field(default_factory=list)

    @contextmanager
    def _call(self, tool: str, **args):
        """Logs a call with its arguments, whether it was refused, and the time it took to plan. Jobs run when its DataFrames are used."""
        began = time.monotonic()
        row = {"tool": tool, "at": datetime.datetime.now(datetime.UTC).isoformat(), "args": {k: v if not isinstance(v, list) or len(v) <= 200 else f"{len(v)} items" for k, v in args.items()}, "result": "planned"}
        try:
            yield
        except RequestError as e:
            row["result"] = f"refused: {e}"
            raise
        except Exception as e:
            row["result"] = f"failed: {e}"[:200]
            raise
        finally:
            row["seconds"] = round(time.monotonic() - began, 3)
            self._log(row)

    def _log(self, row: dict) -> None:
        self.calls.append(row)
        if self.audit:
            self.pending.append(row)
            if len(self.pending) >= self.audit_every:
                self.flush()

    def flush(self) -> None:
        """Append what is not in the audit yet, in one file."""
        rows, self.pending = self.pending, []
        if not rows or not self.audit:
            return
        try:
            lines = [(json.dumps(r, default=str),) for r in rows]
            self.bars.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.audit)
        except Exception as e:  # noqa: BLE001  the audit is advisory
            for r in rows:
                r["audit_error"] = str(e)[:200]

    def run(self, result: DataFrame | dict[str, DataFrame], folder: str | None = None) -> dict[str, list | int]:
        """Execute the DataFrames of a request: collected, or written as Parquet below ``folder`` (their row counts, then).

        Each is logged with its rows, its seconds, and whether it failed; a failure is raised after that.
        """
        parts = result if isinstance(result, dict) else {"rows": result}
        out: dict[str, list | int] = {}
        for name, df in parts.items():
            began, row = time.monotonic(), {"run": name, "at": datetime.datetime.now(datetime.UTC).isoformat(), "result": "done"}
            try:
                if folder is None:
                    out[name] = df.collect()
                    row["rows"] = len(out[name])
                else:
                    seen = Observation()
                    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
                    out[name] = row["rows"] = seen.get["n"]
            except Exception as e:
                row["result"] = f"failed: {e}"[:200]
                raise
            finally:
                row["seconds"] = round(time.monotonic() - began, 3)
                self._log(row)
        return out

    def _rows(self, tickers: list[str] | None, lookback: int, as_of: str | None = None) -> DataFrame:
        if not 1 <= lookback <= 5000:
            raise RequestError("lookback must lie between 1 and 5000")
        df = self._of(tickers, self.bars)
        if as_of is not None:
            df = df.where(F.col("date") <= F.lit(as_of).cast("date"))
        return recent(df, lookback)

    def _hour_rows(self, tickers: list[str] | None, n: int, as_of: str | None = None) -> DataFrame:
        """The newest n hourly bars of each ticker in the daily shape, dated by their time."""
        if self.hours is None:
            raise RequestError("no bars of timeframe 1h")
        hours = self._of(tickers, self.hours)
        if as_of is not None:
            hours = hours.where(F.col("date") <= F.lit(as_of).cast("date"))
        rows = scans.hourly_as_daily(scans.recent_hours(hours, n)).withColumnRenamed("datetime", "date")
        return rows.withColumns({c: F.lit(0.0) for c in ("foreign_buy_value", "foreign_sell_value")})

    @classmethod
    def of_rows(cls, spark, rows: str | list[dict], **more) -> Engine:
        """An engine over daily rows given in the call: dictionaries, or JSON text of them, with the fields of bars; missing ones are null, counts 0."""
        try:
            found = arguments.rows(rows)
        except ValueError as e:
            raise RequestError(str(e)) from e
        read = spark.createDataFrame([(json.dumps(r, default=str),) for r in found], "value string").select(F.from_json("value", BARS).alias("r")).select("r.*")
        return cls(read.where("ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL").fillna(0, COUNTS), **more)

    def _universe(self, universe: list[str] | str | None) -> list[str] | None:
        """The tickers asked for; all (None) if none of them is stored, in the order asked for."""
        universe = arguments.names(universe)
        if universe is None:
            return None
        self._of(universe, self.bars)
        wanted = [t.upper() for t in universe]
        here = {r[0] for r in self.bars.where(F.upper("ticker").isin(wanted)).select(F.upper("ticker")).distinct().collect()}  # of those asked for
        return [t for t in dict.fromkeys(wanted) if t in here] or None

    def _of(self, tickers: list[str] | None, df: DataFrame) -> DataFrame:
        if tickers is None:
            return df
        bad = [t for t in tickers if not re.fullmatch(r"[A-Za-z0-9#]+", t)]
        if bad:
            raise RequestError(f"not a ticker: {bad[0]}")
        return df.where(F.upper("ticker").isin([t.upper() for t in tickers]))

    def prices(self, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, lookback: int = 300, timeframe: str = "1d") -> DataFrame:
        """Rows of a range, of which either end may be open, or the newest ones; daily, or hourly (1h) if the engine has hourly bars.

        A ticker without daily rows in the range gives its newest rows, marked as fallback.
        """
        with self._call("prices", tickers=tickers, start=start, end=end, lookback=lookback, timeframe=timeframe):
            if start and end and start > end:
                raise RequestError("start lies after end")
            if not 1 <= lookback <= 5000:
                raise RequestError("lookback must lie between 1 and 5000")
            if timeframe not in ("1d", "1h") or (timeframe == "1h" and self.hours is None):
                raise RequestError(f"no bars of timeframe {timeframe}")
            if timeframe == "1h":
                hours = self._of(tickers, self.hours)
                return scans.hourly_range(hours, start, end) if start or end else scans.recent_hours(hours, lookback)
            if start or end:
                return scans.price_fallback(self._of(tickers, self.bars), start, end, lookback)
            return self._rows(tickers, lookback).withColumn("fallback", F.lit(False))

    def indicators(self, groups: list[str] | str | None = None, tickers: list[str] | None = None, lookback: int = 300, as_of: str | None = None, params: dict | None = None, series_tail: int = 0, timeframe: str = "1d") -> dict[str, DataFrame]:
        """Each measure of the groups as a DataFrame, named group.measure, over daily or hourly (1h) bars.

        ``params`` sets windows (PARAMS). With ``series_tail`` the groups that have them also give the last points of their series.
        """
        with self._call("indicators", groups=groups, tickers=tickers, lookback=lookback, as_of=as_of, params=params, series_tail=series_tail, timeframe=timeframe):
            if timeframe not in ("1d", "1h"):
                raise RequestError(f"no bars of timeframe {timeframe}")
            own = self._arguments(params)
            rows = self._rows(tickers, lookback, as_of) if timeframe == "1d" else self._hour_rows(tickers, lookback, as_of)
            return self._measures(rows, self._groups(groups), series_tail, own)

    @staticmethod
    def _groups(groups: list[str] | str | None) -> list[str]:
        groups = arguments.names(groups) or list(GROUPS)
        unknown = [g for g in groups if g not in GROUPS]
        if unknown:
            raise RequestError(f"{unknown[0]}: {REFUSED.get(unknown[0], 'unknown group')}")
        return groups

    @staticmethod
    def _arguments(params: dict | None) -> dict[str, dict]:
        """What each measure is called with, from the windows a request sets."""
        own: dict[str, dict] = {}
        for name, value in (params or {}).items():
            if name not in PARAMS:
                raise RequestError(f"unknown parameter {name}")
            many, pairs = name.endswith("_windows"), name.endswith("_pairs")
            if pairs and not all(len(p) == 2 and p[0] < p[1] for p in value):
                raise RequestError(f"{name}: pairs of a fast and a slow window")
            for x in [x for p in value for x in p] if pairs else value if many else [value]:
                if isinstance(x, bool) or not isinstance(x, (int, float) if name in FACTORS else int) or not 0 < x <= 500:
                    raise RequestError(f"{name}: not a window: {x}")
            for measure, argument in PARAMS[name].items():
                own.setdefault(measure, {})[argument] = tuple(map(tuple, value)) if pairs else tuple(value) if many else value
        return own

    @staticmethod
    def _measures(rows: DataFrame, groups: list[str], series_tail: int, own: dict[str, dict]) -> dict[str, DataFrame]:
        if not 0 <= series_tail <= 250:
            raise RequestError("series_tail must lie between 0 and 250")
        out = {f"{g}.{k}": f(rows, **own.get(f"{g}.{k}", {})) for g in groups for k, f in GROUPS[g].items()}
        if series_tail:
            out |= {f"{g}.{k}": recent(f(rows, **own.get(f"{g}.{k}", {})), series_tail) for g in groups for k, f in SERIES.get(g, {}).items()}
        return out

    def flow_summary(self, tickers: list[str] | None = None, window: int = 20) -> DataFrame:
        with self._call("flow_summary", tickers=tickers, window=window):
            if not 2 <= window <= 250:
                raise RequestError("window must lie between 2 and 250")
            return flow.flow_summary(self._rows(tickers, 300), window)

    def multi_horizon(self, tickers: list[str] | None = None, scope: str = "full", lookback: int = 500, as_of: str | None = None, detail: str = "compact", series_tail: int = 0) -> dict[str, DataFrame]:
        """The whole report, as far as the scope asks for it.

        Levels and position; for horizons their components, verdicts, conflicts, alignment, invalidation, perspectives and the averages to watch, and
        how many weekly bars there are; 52-week figures. In full detail also every daily and weekly measure.
        """
        with self._call("multi_horizon", tickers=tickers, scope=scope, lookback=lookback, as_of=as_of, detail=detail, series_tail=series_tail):
            scope, detail = arguments.scope(scope), arguments.word(detail, "compact")
            if scope not in SCOPES:
                raise RequestError(f"unknown scope {scope}")
            if detail not in ("compact", "full"):
                raise RequestError("detail is compact or full")
            rows = self._rows(tickers, lookback, as_of)
            zones = levels.level_clusters(levels.level_candidates(rows))
            out = {"levels": levels.nearest_levels(zones), "position": levels.level_position(zones, rows)}
            if SCOPES[scope]:
                here = F.col("horizon").isin(*SCOPES[scope])
                feats = scoring.features(rows)
                comps = scoring.components(feats).where(here)
                verdict = scoring.verdicts(comps)
                out |= {"components": comps, "verdict": verdict, "conflicts": scoring.conflicts(comps), "alignment": scoring.alignment(verdict), "invalidation": scoring.invalidation(verdict, out["position"]), "levels_to_watch": report.levels_to_watch(feats).where(here), "perspectives": report.perspectives(rows).where(here)}
            weeks = weekly.weekly_bars(rows)
            if scope in ("full", "mid_term", "long_term"):
                out["weekly_bars"] = weeks.groupBy("ticker").agg(F.count(F.lit(1)).alias("available")).withColumn("required", F.lit(WEEKS).cast("long"))
            if scope in ("full", "long_term"):
                out["stats_52w"] = weekly.stats_52w(rows, required=20)  # of so many rows as there are
            if detail == "full":
                out |= {f"daily.{g}.{k}": f(rows) for g, measures in GROUPS.items() for k, f in measures.items()}
                out |= {f"weekly.{k}": f(weeks.where("prev_close IS NOT NULL")) for k, f in WEEKLY.items()}
            if series_tail:
                out |= {f"daily.{g}.{k}": recent(f(rows), series_tail) for g, measures in SERIES.items() for k, f in measures.items()}
            return out

    def report(self, tickers: list[str] | None = None, scope: str = "full", lookback: int = 500, as_of: str | None = None, detail: str = "compact", series_tail: int = 0) -> DataFrame:
        """(ticker, report): :meth:`multi_horizon` as one JSON document a ticker, an array of rows for each of its parts.

        The parts read one scan of the bars, and those a scope leaves out are not planned.
        """
        parts = self.multi_horizon(tickers, scope, lookback, as_of, detail, series_tail)
        every = None
        for name, df in parts.items():
            rest = [c for c in df.columns if c != "ticker"]
            rows = df.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
            every = rows if every is None else every.join(rows, "ticker", "full")
        return every.select("ticker", F.to_json(F.struct(*[F.col(f"`{n}`") for n in parts]), {"ignoreNullFields": "false"}).alias("report"))

    def weekly(self, tickers: list[str] | None = None, lookback: int = 500, groups: list[str] | str | None = None, series_tail: int = 0) -> dict[str, DataFrame]:
        """The measures of the groups over weekly bars, of tickers with ten of them at least.

        Also ``weeks``, how many each ticker has and whether it is refused for it; ``bars``; and ``thin``, weeks of few trading days.
        """
        with self._call("weekly", tickers=tickers, lookback=lookback, groups=groups, series_tail=series_tail):
            rows = self._rows(tickers, lookback)
            bars = weekly.weekly_bars(rows)
            weeks = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("available"))
            weeks = weeks.select("ticker", "available", F.lit(LEAST_WEEKS).cast("long").alias("required"), (F.col("available") < LEAST_WEEKS).alias("refused"))
            enough = bars.join(weeks.where("NOT refused").select("ticker"), "ticker", "left_semi").where("prev_close IS NOT NULL")
            none = F.lit(None).cast("double")
            shaped = enough.withColumns({c: none for c in ("open", "high", "low")})  # weekly bars have closes only
            return {"weeks": weeks, "bars": enough, "thin": weekly.thin_weeks(rows)} | {k: f(enough) for k, f in WEEKLY.items()} | self._measures(shaped, self._groups(groups), series_tail, {})

    def breadth(self, exchange: str = "ALL") -> DataFrame:
        with self._call("breadth", exchange=exchange):
            if self.index is None:
                raise RequestError("no index rows")
            df = weekly.market_breadth(self.index)
            return df if exchange.upper() == "ALL" else df.where(F.col("exchange") == exchange.upper())

    def compare(self, tickers: list[str], lookback: int = 250) -> dict[str, DataFrame]:
        with self._call("compare", tickers=tickers, lookback=lookback):
            if not 2 <= len(set(tickers)) <= 5:
                raise RequestError("two to five tickers can be compared")
            if lookback < 20:
                raise RequestError("lookback must be 20 at least")
            rows = self._rows(tickers, lookback)
            return {"stats_52w": scoring.compare_52w(rows), "averages": scoring.compare_ma(rows), "levels": scoring.compare_levels(rows), "ranks": scoring.rank_observations(rows), "relative": scoring.relative_assessment(rows)}

    def screen(self, strategy: str = "momentum_breakout", universe: list[str] | str | None = None, top_n: int = 5, timeframe: str = "1d") -> DataFrame:
        """The best tickers of the universe by a strategy, with details; of all stored ones if the universe has none of them."""
        with self._call("screen", strategy=strategy, universe=universe, top_n=top_n, timeframe=timeframe):
            if not 1 <= top_n <= 10:
                raise RequestError("top_n must lie between 1 and 10")
            if timeframe not in ("1d", "1h"):
                raise RequestError(f"no bars of timeframe {timeframe}")
            strategy = arguments.word(strategy)
            if strategy not in STRATEGIES and strategy != "intraday_breakout":
                raise RequestError(f"unknown strategy {strategy}")
            universe = self._universe(universe)
            rows = self._rows(universe, 100) if timeframe == "1d" else self._hour_rows(universe, 60)
            order = None if universe is None else self.bars.sparkSession.createDataFrame([(t, i) for i, t in enumerate(universe)], "name string, pos int")
            if order is not None:
                order = scans.list_tickers(rows).join(order, F.upper("ticker") == F.col("name")).select("ticker", "pos")
            if strategy == "intraday_breakout":
                if self.hours is None:
                    raise RequestError("no bars of timeframe 1h")
                return scoring.screen_and_rank(scoring.screen_intraday(scans.recent_hours(self.hours, 60)), rows, top_n, order)
            return scoring.screen_and_rank(STRATEGIES[strategy](rows), rows, top_n, order).join(scoring.screen_details(rows), "ticker").orderBy("rank")

    def foreign_scan(self, window: int = 5, top_n: int = 5, universe: list[str] | str | None = None) -> dict[str, DataFrame]:
        """Largest foreign buyers' and sellers' tickers of the universe; of all stored ones if the universe has none of them."""
        with self._call("foreign_scan", window=window, top_n=top_n, universe=universe):
            if not (1 <= window <= 60 and 1 <= top_n <= 10):
                raise RequestError("window: 1 to 60, top_n: 1 to 10")
            scan = scoring.foreign_scan(self._rows(self._universe(universe), max(2 * window, 20)), window)
            return {"buyers": scoring.foreign_top(scan, top_n), "sellers": scoring.foreign_top(scan, top_n, False), "room_warnings": scoring.room_warnings(scan)}
