"""Row policies and column masks, put under a query as a view: filters of the query see what the policy leaves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Refused


@dataclass(frozen=True)
class Mask:
    """`null`, `partial` (the last `keep` characters stay) or `constant`."""

    kind: str
    keep: int = 4
    value: object = None

    def over(self, c: Column, kind: str) -> Column:
        if self.kind == "null":
            return F.lit(None).cast(kind)
        if self.kind == "constant":
            return F.lit(self.value).cast(kind)
        if self.kind == "partial":
            if kind != "string":
                raise Refused("only text can be masked in part")
            return F.when(c.isNotNull(), F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - self.keep, F.lit(0))), F.when(F.length(c) > self.keep, F.substring(c, -self.keep, self.keep)).otherwise(F.repeat(F.lit("*"), F.length(c)))))
        raise Refused(f"mask {self.kind!r} is unknown")


@dataclass(frozen=True)
class Policy:
    rows: str | None = None
    masks: dict[str, Mask] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    def secure(self, df: DataFrame) -> DataFrame:
        """The row filter sees true values, everything above sees masks."""
        if unknown := [c for c in (*self.masks, *self.hidden) if c not in df.columns]:
            raise Refused(f"no column {', '.join(unknown)}")
        if self.rows:
            df = df.where(F.expr(self.rows))
        kinds = dict(df.dtypes)
        return df.select(*(self.masks[c].over(F.col(c), kinds[c]).alias(c) if c in self.masks else c for c in df.columns if c not in self.hidden))
