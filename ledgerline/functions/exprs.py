"""Column expressions of the panel and filing tables; all of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import truth

#: Share-code tens and units digits, and exchange codes, of the market feed.
SHARE_TENS = {1: "Ordinary Common", 2: "Certificates", 3: "ADR", 4: "Shares of Beneficial Interest", 7: "Units"}
SHARE_UNITS = {0: "Not Further Defined", 1: "Not Needing Further Definition", 2: "Non-US Incorporated", 3: "Americus Trust", 4: "Closed-End Fund", 5: "Closed-End Fund Non-US", 8: "REIT"}
EXCHANGES = {1: "NYSE", 2: "AMEX", 3: "NASDAQ", 4: "ARCA", 5: "BATS"}
#: Spellings of form types that mean the same form.
FORM_ALIASES = {"10KA": "10K/A", "10QA": "10Q/A", "10K405A": "10K405/A", "10KTA": "10KT/A", "10QTA": "10QT/A", "10KSBA": "10KSB/A", "10QSBA": "10QSB/A"}
MICROCAP = 50_000.0


def zfill(c: Column, width: int) -> Column:
    """Left-pads with zeros; longer strings stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def cik10(c: Column) -> Column:
    """Ten-digit identifier: a trailing ``.0`` and all that isn't a digit go, empty is null."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"[^0-9]", "")
    return F.when(digits != "", zfill(digits, 10))


def clean_text(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_form(c: Column) -> Column:
    """Form type in upper case without blanks and dashes, aliases resolved."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"[\s-]", "")
    return mapped(bare, FORM_ALIASES, bare)


def mapped(c: Column, names: Mapping, otherwise: Column | None = None) -> Column:
    """A lookup in a small fixed map as one ``case``."""
    out = None
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(otherwise) if otherwise is not None else out


def share_code_name(c: Column) -> Column:
    """Both digits must be known."""
    tens, units = mapped(F.floor(c / 10), SHARE_TENS), mapped(c % 10, SHARE_UNITS)
    return F.when(tens.isNotNull() & units.isNotNull(), F.concat(tens, F.lit(" / "), units))


def exchange_name(c: Column) -> Column:
    return mapped(c, EXCHANGES)


def common_stock(c: Column) -> Column:
    return truth(c.isin(10, 11))


def major_exchange(c: Column) -> Column:
    return truth(c.isin(1, 2, 3))


def flag_if(predicate: Column, flag: int) -> Column:
    """The bit where the predicate holds; null is off."""
    return F.when(truth(predicate), F.lit(flag).cast("long")).otherwise(F.lit(0).cast("long"))


def or_flags(status: Column, conditional: Mapping[int, Column] | None = None, static: int = 0) -> Column:
    """Provenance bits switched on; a null status counts as none."""
    out = F.coalesce(status, F.lit(0).cast("long")).bitwiseOR(F.lit(static).cast("long"))
    for flag, predicate in (conditional or {}).items():
        out = out.bitwiseOR(flag_if(predicate, flag))
    return out


def has_all(status: Column, mask: int) -> Column:
    return status.bitwiseAND(F.lit(mask).cast("long")) == mask


def market_equity_millions(tcap: Column, price: Column, shares: Column) -> Column:
    return F.coalesce(tcap, F.abs(price) * shares) / 1000


def turnover_ratio(volume: Column, shares: Column) -> Column:
    return F.when(shares > 0, volume / (shares * 1000))


def finite_or_null(c: Column) -> Column:
    """Infinities to null, NaN untouched."""
    return F.when(F.abs(c) != float("inf"), c).when(F.isnan(c), c)


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def guarded_date(c: Column) -> Column:
    """Integer yyyymmdd to a date; out of range or invalid is null."""
    return F.when(c.between(19000101, 21001231), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date"))


def fiscal_year_end(year: Column, month: Column) -> Column:
    ok = year.between(1900, 2100) & month.between(1, 12)
    return F.when(ok, F.last_day(F.make_date(year, month, F.lit(1))))


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def quarter_end_before(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "quarter"), 1)


def month_end_before(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "month"), 1)


def shift_months_to_end(d: Column, months: int) -> Column:
    return F.last_day(F.add_months(d, months))


def score_bin(c: Column, bins: int) -> Column:
    return F.when(c <= 0, 0).when(c >= 1, bins - 1).otherwise(F.floor(c * bins)).cast("long")


def majority_bucket(negative: Column, neutral: Column, positive: Column) -> Column:
    return F.when(negative > 0.5, "negative").when(neutral > 0.5, "neutral").when(positive > 0.5, "positive").otherwise("no_majority")


def token_bucket(n: Column) -> Column:
    """short, medium or long; a longer text raises."""
    named = F.when(n <= 128, "short").when(n <= 256, "medium").when(n <= 512, "long")
    return F.when(named.isNull() & n.isNotNull(), F.raise_error(F.lit("more tokens than the longest bucket"))).otherwise(named)


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def text_flag(c: Column, pattern: str) -> Column:
    return truth(c.rlike(pattern))


def final_return(ret: Column, delist: Column) -> Column:
    """Compounded where both are there, else the one that is."""
    return F.when(ret.isNotNull() & delist.isNotNull(), (1 + ret) * (1 + delist) - 1).otherwise(F.coalesce(delist, ret))


def preferred_identifier(isin: Column, cusip: Column, ticker: Column) -> tuple[Column, Column]:
    """Value and kind of the best identifier."""
    kind = F.when(clean_text(isin).isNotNull(), "ISIN").when(clean_text(cusip).isNotNull(), "CUSIP").when(clean_text(ticker).isNotNull(), "TICKER")
    return F.coalesce(clean_text(isin), clean_text(cusip), clean_text(ticker)), kind


def row_key(*columns: Column) -> Column:
    """Colon-joined key; nulls are dashes."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def clip_span(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A span cut to bounds; a missing end stays missing."""
    return F.when(start.isNotNull(), F.greatest(start, low)), F.when(end.isNotNull(), F.least(end, high))


def scale_variants(negative: Column, neutral: Column, positive: Column) -> dict[str, Column]:
    """Signals drawn from class shares: net tone, dominance, and the logit of the negative share."""
    return {
        "net_negative": negative - positive,
        "net_share": F.when(negative + positive > 0, (negative - positive) / (negative + positive)),
        "dominant": F.greatest(negative, neutral, positive),
        "logit_negative": clipped_logit(negative),
    }


#: Names of text scopes.
SCOPES = {"item1": "1", "item 1": "1", "business": "1", "item1a": "1A", "item 1a": "1A", "risk factors": "1A", "item7": "7", "item 7": "7", "mda": "7", "md&a": "7", "full": "FULL", "full_10k": "FULL"}


def text_scope(c: Column) -> Column:
    """Canonical name of a text scope; unknown names stay as they are, trimmed and in upper case."""
    low = F.lower(F.trim(c))
    return mapped(low, SCOPES, F.upper(F.trim(c)))


def wider_bucket(bucket: Column, n: Column) -> Column:
    """A token bucket that fits ``n``: the one given, or the next that is long enough."""
    order = {"short": 1, "medium": 2, "long": 3}
    need = F.when(n <= 128, 1).when(n <= 256, 2).otherwise(3)
    rank = F.greatest(mapped(bucket, order, F.lit(1)), need)
    return mapped(rank, {v: k for k, v in order.items()})


def sic_code(c: Column) -> Column:
    """An industry code of one to four digits as a number; anything else is null."""
    bare = F.trim(c.cast("string"))
    return F.when(bare.rlike(r"^\d{1,4}$"), bare.try_cast("int"))
