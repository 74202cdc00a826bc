"""Exact money and chain numbers; Python integers only where values are wider than 38 digits."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MILLION = 1_000_000
MAX_TICK = 887272
#: By bit of a tick's size the square root of 1.0001 ** -(2 ** bit), as 128-bit fractions, follow from one rule.
with localcontext() as _c:
    _c.prec = 120
    _HALF = Decimal("1.0001").sqrt()


def shifted(raw: str, digits: int = 18) -> str:
    """SQL of an unsigned integer's text with its point moved, as decimal(38,18): no division that rounds."""
    wide = f"lpad({raw}, greatest(length({raw}), {digits + 1}), '0')"
    return f"case when {raw} rlike '^[0-9]+$' then try_cast(concat(left({wide}, length({wide}) - {digits}), '.', right({wide}, {digits})) as decimal(38,18)) end"


def wei(raw: str, digits: int = 18) -> Column:
    """Text of an integer as decimal(38,18); null where it is no integer or too wide for Spark's decimals."""
    return F.expr(shifted(raw, digits))


def part(amount: str, millionths: str) -> str:
    """SQL of amount x millionths / 1e6 without loss: decimal(24,18) x decimal(7,6)."""
    return f"{amount} * cast(cast({millionths} as decimal(12,0)) / 1000000 as decimal(7,6))"


def commission(amount: str, fee_share: str) -> str:
    return part(amount, f"({MILLION} - {fee_share})")


def percent(raw: str) -> Column:
    """Millionths in text as a percentage; null where it is no number."""
    return F.expr(f"cast(try_cast({raw} as decimal(20,0)) / 10000 as decimal(10,4))")


def uint_text(word: str) -> str:
    """SQL of the decimal text of an unsigned integer of 256 bits, given as 64 lower-case hex digits.

    Up to 64 bits are what ``conv`` has, up to 120 fit Spark's decimals. Wider ones are turned from eight digits of base 2 ** 32 into nine of base 1e9, whose products fit 64 bits.
    """
    small = f"cast(cast(cast(conv(substring({word}, 35, 15), 16, 10) as decimal(20,0)) * cast(1152921504606846976 as decimal(19,0)) as decimal(38,0)) + cast(conv(right({word}, 15), 16, 10) as decimal(20,0)) as decimal(38,0))"
    limbs = f"transform(sequence(0, 7), i -> cast(conv(substring({word}, 8 * i + 1, 8), 16, 10) as bigint))"
    step = "aggregate(acc, named_struct('carry', limb, 'all', cast(array() as array<bigint>)), (s, d) -> named_struct('carry', (d * 4294967296L + s.carry) div 1000000000L, 'all', array_append(s.all, (d * 4294967296L + s.carry) % 1000000000L)), s -> s.all)"
    digits = f"aggregate({limbs}, array_repeat(0L, 9), (acc, limb) -> {step})"
    wide = f"ltrim('0', array_join(transform(reverse({digits}), d -> lpad(cast(d as string), 9, '0')), ''))"
    return f"case when left({word}, 48) = repeat('0', 48) then conv(right({word}, 16), 16, 10) when left({word}, 34) = repeat('0', 34) then cast({small} as string) else {wide} end"


def inverse_percent(raw: str) -> Column:
    return F.expr(f"cast(({MILLION} - try_cast({raw} as decimal(20,0))) / 10000 as decimal(10,4))")


def gas_fee(used: str, effective: str, price: str) -> Column:
    """used x price in units of 1e18; each is divided by 1e9 first, which keeps the product exact."""
    return F.expr(f"cast(cast({used} / 1000000000 as decimal(18,9)) * cast(coalesce({effective}, {price}) / 1000000000 as decimal(19,9)) as decimal(38,18))")


def wide_wei(raw: str | None, digits: int = 18) -> str | None:
    """Any unsigned integer in text, of up to 78 digits, shifted by ``digits`` places."""
    if raw is None or not raw.isdigit():
        return None
    s = raw.rjust(digits + 1, "0")
    return f"{s[:-digits].lstrip('0') or '0'}.{s[-digits:]}"


wide_wei_udf = F.udf(wide_wei, StringType(), useArrow=True)


def tick_to_sqrt_price(tick: int | None) -> int | None:
    """sqrt(1.0001 ** tick) * 2 ** 96 in the fixed-point steps of the pool contracts, rounded up."""
    if tick is None:
        return None
    if abs(tick) > MAX_TICK:
        raise ValueError(f"tick {tick} is out of range")
    ratio = 1 << 128
    for bit in range(20):
        if abs(tick) >> bit & 1:
            ratio = ratio * _step(bit) >> 128
    if tick > 0:
        ratio = ((1 << 256) - 1) // ratio
    return (ratio >> 32) + (ratio & 0xFFFFFFFF != 0)


_STEPS: dict[int, int] = {}


def _step(bit: int) -> int:
    """1.0001 ** -(2 ** bit / 2) as a 128-bit fraction, to the nearest."""
    if bit not in _STEPS:
        with localcontext() as c:
            c.prec = 120
            _STEPS[bit] = int((Decimal(1 << 128) / (_HALF ** (1 << bit))).to_integral_value())
    return _STEPS[bit]


def tick_to_price(tick: int | None) -> str | None:
    """The square of the root price, as a decimal string with 30 places."""
    s = tick_to_sqrt_price(tick)
    return None if s is None else root_to_price(str(s))


def root_to_price(root: str | None) -> str | None:
    """The price of a pool by its own root price in units of 2 ** -96, as a decimal string with 30 places."""
    if root is None:
        return None
    with localcontext() as c:
        c.prec = 110
        return f"{Decimal(root) * Decimal(root) / (1 << 192):.30f}"


def mean_tick(delta: int | None, seconds: int = 1800) -> int | None:
    """Floor, toward minus infinity."""
    return None if delta is None else delta // seconds


tick_to_price_udf = F.udf(tick_to_price, StringType(), useArrow=True)
root_to_price_udf = F.udf(root_to_price, StringType(), useArrow=True)
tick_to_sqrt_udf = F.udf(lambda t: None if t is None else str(tick_to_sqrt_price(t)), StringType(), useArrow=True)


def mean_tick_sql(delta: str, seconds: int = 1800) -> str:
    return f"cast(floor(cast({delta} as decimal(30,0)) / {seconds}) as bigint)"


def oracle_status(lpt: bool) -> Column:
    """The ordered checks on an oracle reading: columns feed_empty, sequencer_answer, pool_empty, aggregator_empty,
    answered_in_round, round_id, age_s, answer, cardinality, observe_failed."""
    steps = [("feed_empty", "missing_oracle"), ("sequencer_answer <> 0", "sequencer_outage")]
    steps += [("pool_empty", "missing_pool")] if lpt else []
    steps += [("aggregator_empty", "missing_oracle"), ("answered_in_round < round_id", "missing_oracle"), ("age_s > 86400", "missing_oracle"), ("answer <= 0", "missing_oracle")]
    steps += [("cardinality < 144", "degraded"), ("observe_failed", "missing_pool")] if lpt else []
    return F.expr("case " + " ".join(f"when {c} then '{s}'" for c, s in steps) + " else 'ok' end")


def revert_kind(message: str) -> Column:
    return F.when(F.lower(F.col(message)).contains("execution reverted"), "failed_missing_pool").otherwise("retryable")


def normalised(decimal_text: str) -> Column:
    """A decimal's text without trailing zeros."""
    return F.expr(rf"regexp_replace(regexp_replace({decimal_text}, r'(\.\d*?)0+$', '$1'), r'\.$', '')")


def topic_of(address: str) -> Column:
    return F.expr(f"concat('0x', repeat('0', 24), lower(substring({address}, 3)))")


def call_hash(method: str | Column, params: str | Column, block: str | Column) -> Column:
    """sha256 of method, params and the block as eight bytes, zero bytes between the first two."""
    method, params, block = (F.col(c) if isinstance(c, str) else c for c in (method, params, block))
    return F.sha2(F.concat(method.cast("binary"), F.lit(b"\x00"), params.cast("binary"), F.lit(b"\x00"), F.unhex(F.lpad(F.hex(block), 16, "0"))), 256)


def tz_bucket(bucket: str, ts: str, tz: str) -> Column:
    """Start of the day, week (Monday) or month that a UTC time is in, in a time zone, as UTC time."""
    local = f"from_utc_timestamp(cast({ts} as timestamp), '{tz}')"
    return F.expr(f"cast(to_utc_timestamp(date_trunc('{bucket}', {local}), '{tz}') as timestamp_ntz)")
