"""Expressions that sort texts and requests by fixed lists of wording; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import bounded, signals_of

# Fixed values, equal to those whose results are matched: wording of promises that no honest source makes.
RED_FLAGS = {
    "GUARANTEED_PROFIT": r"guaranteed (profit|returns?|income|gains?)",
    "NEVER_LOSES": r"never (loses|lose|had a losing)",
    "PERFECT_ACCURACY": r"100\s?% (accurate|accuracy|win rate)",
    "EXTREME_WIN_RATE": r"\b9\d(\.\d+)?\s?% win(ning)? rate",
    "RISK_FREE": r"\brisk[- ]free (profit|returns?|strategy|trading|income)",
    "SECRET_STRATEGY": r"\bsecret (strategy|formula|system|method)",
    "HOLY_GRAIL": r"\bholy grail\b",
    "AI_PREDICTS_ALL": r"\bai predicts (every|all)",
    "GET_RICH": r"turn \$?\d[\d,]* into \$?\d[\d,]*\s?(k|m|million|thousand)?",
    "INSTITUTIONAL_SECRET": r"\binstitutional secret",
    "MARTINGALE": r"\bmartingale\b",
    "DOUBLE_AFTER_LOSS": r"double (the |your )?(position|lot|size|stake|bet)s? (after|on) (every |each |a )?loss",
    "AVERAGING_DOWN": r"\b(average|averaging) down\b",
}
# Words of requests, by what they ask for; the order of the last two decides.
ASSET_WORDS = {
    "ETF": r"\betfs?\b|sector rotation",
    "STOCK": r"\bstocks?\b|\bequit(y|ies)\b|\bshares\b",
    "OPTIONS": r"\boptions?\b|\bspx\b|0dte|\bvix\b|volatility risk premium|put[- ]writ",
    "FOREX": r"\bfx\b|forex|currenc(y|ies)",
    "CRYPTO": r"crypto|bitcoin|\bbtc\b|\beth\b|ethereum|perpetual|funding rate",
    "FUTURES": r"\bfutures\b|commodit",
}
REGIME_WORDS = {
    "CRASH": r"crash|tail[- ]?(risk|hedg)|crisis|protection|black swan",
    "BEARISH": r"\bbear(ish)?\b|downtrend|falling market",
    "BULLISH": r"\bbull(ish)?\b|uptrend|rising market",
    "CONSOLIDATION": r"sideways|range[- ]bound|consolidat|choppy",
}
MODES = {"ACADEMIC_ONLY": r"\bacademic\b|papers? only", "DEEP_RESEARCH": r"\bdeep\b|thorough", "QUICK_DISCOVERY": r"\bquick\b", "RECENT_ONLY": r"\brecent\b|latest|new"}
FILLER = "find|search|look for|discover|me|some|good|reliable|best|strategies|strategy|ideas?|for|the|a|an|of|in|on|with|that|work|works"
# Words of which a source about finance has one.
FINANCE_WORDS = (
    r"\b(trad\w*|stocks?|equit\w*|markets?|prices?|returns?|portfolios?|invest\w*|financ\w*|forex|currenc\w*|"
    r"futures|options?|crypto\w*|bitcoin|etfs?|funds?|hedg\w*|volatil\w*|momentum|sharpe|assets?|indicators?|"
    r"technical analysis|securities|commodit\w*|bonds?|interest rates?)\b"
)


def _low(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def red_flags(text: Column) -> Column:
    """Sorted names of the promises that ``text`` makes."""
    return signals_of(_low(text), RED_FLAGS)


def about_finance(text: Column) -> Column:
    return F.lower(_low(text)).rlike(bounded(FINANCE_WORDS))


def request_parts(text: Column) -> Column:
    """struct(assets, regimes, mode, core): what a request in words asks for; the core is the request without filling words."""
    low = F.lower(_low(text))
    listed = lambda words: F.array_compact(F.array(*[F.when(low.rlike(bounded(rx)), F.lit(name)) for name, rx in words.items()]))
    mode = F.coalesce(*[F.when(low.rlike(bounded(rx)), F.lit(name)) for name, rx in MODES.items()], F.lit("QUICK_DISCOVERY"))
    # Every word that is not part of a longer one by a hyphen; twice, since neighbours share the blank between them.
    bare = F.concat(F.lit(" "), _low(text), F.lit(" "))
    for _ in range(2):
        bare = F.regexp_replace(bare, rf"(?i)([^\w-])(?:{FILLER})([^\w-])", "$1 $2")
    return F.struct(listed(ASSET_WORDS).alias("assets"), listed(REGIME_WORDS).alias("regimes"), mode.alias("mode"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("core"))


def official_api(host: Column, path: Column, exact: list[tuple[str, str]], prefixes: list[tuple[str, str]]) -> Column:
    """Whether a request goes to a listed address: (host, path) as it is, or a path below a listed one."""
    hit = F.lit(False)
    for h, p in exact:
        hit |= (host == h) & (path == p)
    for h, p in prefixes:
        hit |= (host == h) & path.startswith(p)
    return F.coalesce(hit, F.lit(False))
