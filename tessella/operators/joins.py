"""Equi-joins with typed keys and a defined row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import ArgumentError, TypeMismatchError
from tessella.names import ORDER, check_unique, quoted, resolve
from tessella.operators.frame import Frame
from tessella.plans.order import nested, order_type, with_order

#: Types that have no equality for keys.
NO_KEY = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


class PendingJoin:
    """A join that waits for its keys."""

    def __init__(self, left: Frame, right: Frame, kind: str) -> None:
        self._left, self._right, self._kind = left, right, kind

    def on(self, *keys: str | tuple[str, str]) -> Frame:
        """Join on names (shared by both sides) or on ``(left, right)`` pairs.

        A shared key becomes one column (left value, else right value); keys of different names are both
        kept. Null keys never match. Keys of different types never match, without any conversion. A right
        column that is no shared key must not have the name of a left column.
        """
        if not keys:
            raise ArgumentError("a join needs at least one key")
        pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
        if any(len(p) != 2 for p in pairs):
            raise ArgumentError("a key is a name or a pair of names")
        pairs = [(resolve(self._left.columns_list, a), resolve(self._right.columns_list, b)) for a, b in pairs]
        check_unique([a for a, _ in pairs], "left key")
        check_unique([b for _, b in pairs], "right key")
        shared = {b: a for a, b in pairs if a.lower() == b.lower()}
        taken = {c.lower() for c in self._left.columns_list}
        for c in self._right.columns_list:
            if c not in shared and c.lower() in taken:
                raise ArgumentError(f"both sides have a column {c!r}")
        for a, b in pairs:
            for f in (self._left.field(a), self._right.field(b)):
                if isinstance(f.dataType, NO_KEY):
                    raise TypeMismatchError(f"column {f.name!r} ({f.dataType.simpleString()}) can't be a key")
        return self._run(pairs, shared)

    def _run(self, pairs: list[tuple[str, str]], shared: dict[str, str]) -> Frame:
        lf, rf, kind = self._left, self._right, self._kind
        left = _prefixed(with_order(lf._df), "l")
        right = _prefixed(with_order(rf._df), "r")
        same = all(_same_type(lf.field(a).dataType, rf.field(b).dataType) for a, b in pairs)
        if same:
            test = reduce(lambda x, y: x & y, [F.col(quoted(f"l:{a}")) == F.col(quoted(f"r:{b}")) for a, b in pairs])
            joined = left.join(right, test, {"full": "full_outer"}.get(kind, kind))
        else:
            joined = _unmatched(left, right, kind)
        lo, ro = F.col(f"`l:{ORDER}`"), F.col(f"`r:{ORDER}`")
        order = {"inner": (lo, ro), "left": (lo, ro), "right": (ro, lo), "full": (lo.isNull(), lo, ro)}[kind]
        out = []
        back = {a: b for b, a in shared.items()}
        for c in lf.columns_list:
            v = F.col(quoted(f"l:{c}"))
            if c in back and kind in ("right", "full"):
                other = F.col(quoted(f"r:{back[c]}"))
                # A right join matches or has no left row: the right key is the value either way.
                v = (other if kind == "right" else F.coalesce(v, other)) if same else F.coalesce(v, other.cast(lf.field(c).dataType))
            out.append(v.alias(c))
        out += [F.col(quoted(f"r:{c}")).alias(c) for c in rf.columns_list if c not in shared]
        declared = {c for c in lf.columns_list if not lf.field(c).nullable and (kind in ("inner", "left") or c in back)}
        declared |= {c for c in rf.columns_list if c not in shared and not rf.field(c).nullable and kind in ("inner", "right")}
        return Frame(joined.select(*out, nested(*order).alias(ORDER)), frozenset(declared))


def _prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(quoted(c)).alias(f"{side}:{c}") for c in df.columns])


def _same_type(a: T.DataType, b: T.DataType) -> bool:
    """Decimals of any scale compare by value; all other types must be the same."""
    return a == b or isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType)


def _unmatched(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """The join of two sides without any match."""
    nulls = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    a, b = left.select("*", *nulls(right)), right.select(*nulls(left), "*")
    return {"inner": a.filter(F.lit(False)), "left": a, "right": b, "full": a.unionByName(b)}[kind]


__all__ = ["PendingJoin", "order_type"]
