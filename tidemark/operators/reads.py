"""Contract state from the memo of calls: each call is found by its hash, and what it returned is decoded.

The memo is a table (call_hash, response), filled by whatever makes the calls; a call that is not in it has no answer yet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.abi import encoded, let, values
from tidemark.functions.money import call_hash


class Call(NamedTuple):
    """``asks`` are types and the SQL of the values; ``gives`` are names and types of what is returned."""

    name: str
    selector: str
    asks: tuple[tuple[str, str], ...]
    gives: tuple[tuple[str, str], ...]


def hash_of(call: Call, contract: str, block: str = "block_number") -> Column:
    """The hash of eth_call with the call's data at a block; parameters are JSON with the contract and the data."""
    data = encoded([k for k, _ in call.asks], [v for _, v in call.asks])
    params = F.concat(F.lit(f'{{"to":"{contract}","data":"0x{call.selector}'), data, F.lit('"}'))
    return call_hash(F.lit("eth_call"), params, F.col(block))


def answered(rows: DataFrame, calls: list[Call], contract: str, memo: DataFrame, block: str = "block_number") -> DataFrame:
    """``rows`` with a struct of texts for each call, null where there is no answer or none that fits, and ``missing`` and ``unfit``: names of those calls.

    All calls look into the memo in one form, so it is shuffled once for all of them, and an answer is decoded once, after the row that asks for it is found.
    """
    rows = rows.withColumns({f"_h_{c.name}": hash_of(c, contract, block) for c in calls})
    told = memo.selectExpr("call_hash", "if(startswith(response, '0x'), substring(response, 3), response) as _hex").selectExpr("call_hash", "if(length(_hex) % 64 = 0, unhex(_hex), null) as _data", "true as _told")
    for c in calls:
        made = lambda data, c=c: f"named_struct({', '.join(f"'{n}', {v}" for (n, _), v in zip(c.gives, values([k for _, k in c.gives], data), strict=True))})"
        whole = lambda s, c=c: f"if({' or '.join(f'{s}.{n} is null' for n, _ in c.gives)}, null, {s})"
        good = F.expr(f"if(_data is null, null, {let(let('_data', made), whole)})")
        kept = [k for k in rows.columns if k != f"_h_{c.name}"]
        rows = rows.join(told.withColumnRenamed("call_hash", f"_h_{c.name}"), f"_h_{c.name}", "left")
        # an array of one, as in the decoding of logs: a condition on the answer waits for it, and does not decode it again
        rows = rows.select(*kept, F.inline(F.array(F.struct(good.alias(c.name), F.col("_told").alias(f"_t_{c.name}")))))
    named = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(c), c.name) for c in calls])), ",")
    rows = rows.withColumn("missing", named(lambda c: F.col(f"_t_{c.name}").isNull())).withColumn("unfit", named(lambda c: F.col(f"_t_{c.name}").isNotNull() & F.col(c.name).isNull()))
    return rows.drop(*[f"_t_{c.name}" for c in calls])
