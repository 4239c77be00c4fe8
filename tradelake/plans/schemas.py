"""The 25 tables: columns, keys, references, rules and immutability, with deterministic constraint names.

One text per table states its columns as "name type", with "?" behind a nullable type, "=value" for a default and ">table.col"
for a foreign key. Types: uuid, long, int, short, bool, text, json, timestamp, timestamp_ntz, date, varchar(n), the decimals
below, and enum names of DOMAINS.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Decimal precision and scale by meaning.
DECIMALS = {"price": (24, 10), "volume": (16, 4), "money": (20, 4), "points": (20, 4), "ratio": (14, 6), "percent": (10, 4)}

#: Closed domains, stored as text.
DOMAINS = {
    "AccountType": ("DEMO", "REAL", "CONTEST"),
    "MarginMode": ("HEDGING", "NETTING", "EXCHANGE"),
    "BotStatus": ("ACTIVE", "PAUSED", "RETIRED"),
    "RawEventStatus": ("PENDING", "PROCESSED", "FAILED", "IGNORED"),
    "TradeSource": ("LIVE", "DEMO", "BACKTEST", "FORWARD", "IMPORTED"),
    "TradeStatus": ("OPEN", "CLOSED"),
    "Direction": ("BUY", "SELL"),
    "TradeEventType": ("TRADE_OPENED", "SL_MODIFIED", "TP_MODIFIED", "PARTIAL_CLOSE", "REENTRY", "POSITION_INCREASED", "POSITION_DECREASED", "TRADE_CLOSED"),
    "ExitReason": ("SL", "TP", "MANUAL", "EXPERT", "STOP_OUT", "MIXED", "UNKNOWN"),
    "ExcursionSource": ("EA_TICKS", "M1_BARS"),
    "DataOrigin": ("EA", "SERVER"),
    "Outcome": ("WIN", "LOSS", "BREAKEVEN"),
    "FindingKind": ("FACT", "HYPOTHESIS"),
    "HypothesisStatus": ("PROPOSED", "TESTING", "VALIDATED", "REJECTED", "DECAYED"),
    "SplitSegment": ("TRAIN", "VALIDATION", "OOS", "FORWARD"),
    "ExperimentStatus": ("DRAFT", "RUNNING", "COMPLETED", "ABANDONED"),
    "AlertSeverity": ("INFO", "WARNING", "CRITICAL"),
}

#: The columns of each table.
COLUMNS = {
    "brokers": "id uuid, name varchar(128), server_utc_offset_policy varchar(32) =EA_REPORTED, notes varchar(2000)?, created_at timestamp =now()",
    "accounts": "id uuid, broker_id uuid >brokers.id, login long, server varchar(128), currency varchar(8), account_type AccountType, margin_mode MarginMode, leverage int?, active bool =true, notes varchar(2000)?, created_at timestamp =now()",
    "terminals": "id uuid, account_id uuid >accounts.id, name varchar(128), host_description varchar(256)?, last_seen_at timestamp?, created_at timestamp =now()",
    "api_clients": "id uuid, terminal_id uuid >terminals.id, key_prefix varchar(16), key_hash varchar(128), created_at timestamp =now(), revoked_at timestamp?",
    "users": "id uuid, username varchar(64), password_hash varchar(256), active bool =true, created_at timestamp =now()",
    "bots": "bot_id uuid, name varchar(128), strategy varchar(256), description text?, status BotStatus =ACTIVE, notes text?, created_at timestamp =now()",
    "bot_versions": "id uuid, bot_id uuid >bots.bot_id, version varchar(32), main_timeframe varchar(8), params json ={}, params_hash varchar(64)?, source_hash varchar(64)?, changelog text?, released_at timestamp, created_at timestamp =now()",
    "deployments": "id uuid, bot_version_id uuid >bot_versions.id, account_id uuid >accounts.id, symbol varchar(64), magic_number long, started_at timestamp, ended_at timestamp?, notes text?, created_at timestamp =now()",
    "raw_events": "id long, terminal_id uuid >terminals.id, idempotency_key varchar(200), event_type varchar(48), schema_version short, payload json ={}, sent_at timestamp, received_at timestamp =now(), status RawEventStatus =PENDING, attempts short =0, processed_at timestamp?, error text?",
    "trades": "trade_id uuid, account_id uuid >accounts.id, deployment_id uuid? >deployments.id, bot_version_id uuid? >bot_versions.id, position_id long, magic_number long, symbol varchar(64), direction Direction, order_type varchar(32), source TradeSource, status TradeStatus =OPEN, comment varchar(64)?, symbol_digits short?, symbol_point price?, tick_size price?, tick_value money?, contract_size money?, entry_time timestamp, entry_price price, initial_sl price?, initial_tp price?, initial_volume volume, max_volume volume, risk_amount money?, risk_percent percent?, balance_at_entry money?, close_time timestamp?, close_price price?, gross_profit money?, commission money?, swap money?, net_profit money?, points points?, duration_seconds int?, exit_reason ExitReason?, mfe_points points?, mae_points points?, max_floating_profit money?, max_floating_drawdown money?, excursion_source ExcursionSource?, reentry_of_trade_id uuid? >trades.trade_id, data_quality json ={}, created_at timestamp =now(), updated_at timestamp =now()",
    "trade_events": "event_id uuid, trade_id uuid >trades.trade_id, raw_event_id long? >raw_events.id, event_type TradeEventType, event_time_utc timestamp, event_time_server timestamp_ntz?, price price?, volume volume?, sl price?, tp price?, deal_ticket long?, order_ticket long?, profit money?, commission money?, swap money?, is_inferred bool =false, extra json ={}, created_at timestamp =now()",
    "account_snapshots": "account_id uuid >accounts.id, ts timestamp, balance money, equity money, margin money?, free_margin money?, open_positions int",
    "heartbeats": "terminal_id uuid >terminals.id, ts timestamp, ea_version varchar(64), terminal_connected bool, trade_allowed bool, info json ={}",
    "price_bars": "broker_id uuid >brokers.id, symbol varchar(64), timeframe varchar(8), bar_time timestamp, open price, high price, low price, close price, tick_volume long, spread int?",
    "feature_definitions": "name varchar(64), version short, group varchar(32), timeframe varchar(8)?, formula_doc text, null_policy text, available bool, created_at timestamp =now()",
    "trade_dna": "trade_id uuid >trades.trade_id, feature_set_version short, computed_at timestamp =now(), source DataOrigin, data_cutoff timestamp, trend_m1 short?, trend_m5 short?, trend_m15 short?, trend_h1 short?, trend_h4 short?, trend_d1 short?, ema20 price?, ema50 price?, ema200 price?, rsi ratio?, atr price?, roc ratio?, adx ratio?, market_structure varchar(16)?, last_swing_high price?, last_swing_low price?, bos_recent bool?, choch_recent bool?, is_range bool?, liquidity_sweep bool?, equal_highs bool?, equal_lows bool?, dist_prev_high_points points?, dist_prev_low_points points?, fvg_present bool?, fvg_direction short?, fvg_size_points points?, fvg_distance_points points?, ob_present bool?, ob_direction short?, ob_distance_points points?, spread_points points?, recent_range_points points?, relative_volatility ratio?, weekday short?, hour_utc short?, session_asia bool?, session_london bool?, session_newyork bool?, news_nearby bool?, minutes_to_news int?, news_impact varchar(16)?, news_type varchar(64)?, extra json ={}, null_reasons json ={}",
    "trade_analyses": "id uuid, trade_id uuid >trades.trade_id, analysis_version short, outcome Outcome, created_at timestamp =now()",
    "analysis_findings": "id uuid, analysis_id uuid >trade_analyses.id, kind FindingKind, code varchar(64), text text, evidence json ={}, hypothesis_id uuid? >hypotheses.id, created_at timestamp =now()",
    "news_events": "id uuid, time_utc timestamp, currency varchar(8), impact varchar(16), title varchar(256), source varchar(64), created_at timestamp =now()",
    "hypotheses": "id uuid, statement text, condition_spec json ={}, scope json ={}, status HypothesisStatus =PROPOSED, created_at timestamp =now()",
    "data_splits": "id uuid, scope json ={}, train_end timestamp, validation_end timestamp, oos_end timestamp, frozen_at timestamp =now(), notes text?",
    "pattern_tests": "id uuid, hypothesis_id uuid >hypotheses.id, split_id uuid >data_splits.id, segment SplitSegment, n int, win_rate ratio?, expectancy ratio?, profit_factor ratio?, ci_low ratio?, ci_high ratio?, p_value ratio?, p_adjusted ratio?, tests_in_family int, method varchar(64), run_at timestamp =now()",
    "experiments": "id uuid, code varchar(16), base_version_id uuid >bot_versions.id, candidate_version_id uuid? >bot_versions.id, hypothesis_id uuid? >hypotheses.id, change_description text, status ExperimentStatus =DRAFT, conclusion text?, created_at timestamp =now()",
    "backtest_runs": "id uuid, experiment_id uuid? >experiments.id, bot_version_id uuid >bot_versions.id, symbol varchar(64), period_start date, period_end date, model varchar(64), initial_deposit money?, report_file varchar(512)?, metrics json ={}, imported_at timestamp =now()",
    "alerts": "id uuid, rule varchar(64), severity AlertSeverity, bot_version_id uuid? >bot_versions.id, deployment_id uuid? >deployments.id, message text, data json ={}, created_at timestamp =now(), acknowledged_at timestamp?",
}

#: Primary keys that are not the first column alone.
PRIMARY_KEYS = {
    "account_snapshots": ("account_id", "ts"),
    "heartbeats": ("terminal_id", "ts"),
    "price_bars": ("broker_id", "symbol", "timeframe", "bar_time"),
    "feature_definitions": ("name", "version"),
    "trade_dna": ("trade_id", "feature_set_version"),
}
#: Unique keys.
UNIQUE = {
    "brokers": ("name",),
    "accounts": ("server", "login"),
    "terminals": ("name",),
    "api_clients": ("key_prefix",),
    "users": ("username",),
    "bots": ("name",),
    "bot_versions": ("bot_id", "version"),
    "raw_events": ("terminal_id", "idempotency_key"),
    "trades": ("account_id", "position_id"),
    "trade_analyses": ("trade_id", "analysis_version"),
    "news_events": ("source", "time_utc", "currency", "title"),
    "experiments": ("code",),
}
#: Unique keys over the rows that fulfil a condition: name, key, condition.
PARTIAL_UNIQUE = {
    "deployments": ("uq_deployments_active_magic", ("account_id", "magic_number", "symbol"), "ended_at IS NULL"),
    "trade_events": ("uq_trade_events_trade_id_deal_ticket", ("trade_id", "deal_ticket"), "deal_ticket IS NOT NULL"),
}
#: Business rules. A row passes if the rule is true or null.
CHECKS = {
    "bot_versions": {"semver": r"version RLIKE r'\A[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?\z'"},
    "deployments": {"dates": "ended_at IS NULL OR ended_at > started_at"},
    "trades": {"closed_has_close_time": "status = 'OPEN' OR close_time IS NOT NULL", "time_order": "close_time IS NULL OR close_time >= entry_time", "positive_volume": "initial_volume > 0"},
    "price_bars": {"high_low": "high >= low", "high_bounds": "high >= open AND high >= close", "low_bounds": "low <= open AND low <= close"},
    "data_splits": {"ordered": "train_end < validation_end AND validation_end < oos_end"},
    "pattern_tests": {"n_non_negative": "n >= 0"},
    "backtest_runs": {"period": "period_end > period_start"},
}
#: Tables whose rows cannot be changed or deleted, and tables whose rows cannot be deleted.
APPEND_ONLY = ("bot_versions", "trade_events", "trade_analyses", "analysis_findings", "pattern_tests", "data_splits")
NO_DELETE = ("bots", "deployments", "trades", "accounts", "raw_events")
#: The only columns of a table that an update may change.
MUTABLE_COLUMNS = {"raw_events": ("status", "attempts", "processed_at", "error")}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    size: int | None
    nullable: bool
    default: str | None
    parent: tuple[str, str] | None

    @property
    def domain(self) -> tuple[str, ...] | None:
        return DOMAINS.get(self.kind)

    def spark_type(self) -> T.DataType:
        if self.kind in DECIMALS:
            return T.DecimalType(*DECIMALS[self.kind])
        names = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType()}
        return names.get(self.kind, T.StringType())


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    unique: tuple[str, ...] | None = None
    partial_unique: tuple[str, tuple[str, ...], str] | None = None
    checks: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), c.nullable) for c in self.columns])

    @property
    def foreign_keys(self) -> list[tuple[str, str, str, str]]:
        """(constraint, column, parent table, parent column)."""
        return [(f"fk_{self.name}_{c.name}_{c.parent[0]}", c.name, *c.parent) for c in self.columns if c.parent]

    @property
    def unique_keys(self) -> list[tuple[str, tuple[str, ...], str | None]]:
        """(constraint, key, condition); the primary key first."""
        keys: list[tuple[str, tuple[str, ...], str | None]] = [(f"pk_{self.name}", self.primary_key, None)]
        if self.unique:
            keys.append((f"uq_{self.name}_{'_'.join(self.unique)}", self.unique, None))
        if self.partial_unique:
            keys.append(self.partial_unique)
        return keys


_COLUMN = re.compile(r"(\w+) (\w+)(?:\((\d+)\))?(\?)?(?: =(\S+))?(?: >(\w+)\.(\w+))?")


def _table(name: str) -> Table:
    columns = []
    for text in COLUMNS[name].split(", "):
        m = _COLUMN.fullmatch(text)
        column, kind, size, optional, default, parent, key = m.groups()
        columns.append(Column(column, kind, int(size) if size else None, bool(optional), default, (parent, key) if parent else None))
    return Table(name, tuple(columns), PRIMARY_KEYS.get(name, (columns[0].name,)), UNIQUE.get(name), PARTIAL_UNIQUE.get(name), CHECKS.get(name, {}))


TABLES: dict[str, Table] = {name: _table(name) for name in COLUMNS}


def schema_diff(expected: T.StructType, found: T.StructType) -> list[str]:
    """What differs between two schemas, nullability aside, as files do not keep it; empty if nothing does."""
    want, got = ({f.name: f.dataType for f in s} for s in (expected, found))
    out = [f"missing {n}" for n in want if n not in got] + [f"unexpected {n}" for n in got if n not in want]
    return out + [f"{n}: {want[n].simpleString()} became {got[n].simpleString()}" for n in want if n in got and want[n] != got[n]]
