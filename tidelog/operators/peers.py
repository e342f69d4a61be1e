"""Peer lists of the form id=host:port,... as relations, and a client's routing policy."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 10


def entries(lists: DataFrame, text: str = "peers", name: str = "list_id") -> DataFrame:
    """(list_id, id, address, problem): one row per entry that is not blank.

    `problem` is null for a good entry, else what is wrong with it: no_equals, bad_id, no_address or repeated_id.
    """
    each = lists.select(name, F.posexplode(F.split(F.coalesce(text, F.lit("")), ",")).alias("_at", "_entry"))
    each = each.withColumn("_entry", F.trim("_entry")).filter("_entry <> ''")
    at = F.instr("_entry", "=")
    id_text = F.trim(F.substring("_entry", F.lit(1), at - 1))
    id_ = F.when(F.col("_id_text").rlike(r"^[+-]?\d+$"), F.expr("try_cast(_id_text AS int)"))
    cut = each.select(name, "_at", at.alias("_eq"), id_text.alias("_id_text"), F.trim(F.expr("substring(_entry, instr(_entry, '=') + 1)")).alias("address"))
    cut = cut.withColumn("id", id_)
    # A list is a few entries, so a window over one is small.
    again = F.row_number().over(Window.partitionBy(name, "id").orderBy("_at")) > 1
    problem = (
        F.when(F.col("_eq") == 0, "no_equals")
        .when(F.col("id").isNull(), "bad_id")
        .when(F.col("address") == "", "no_address")
        .when(again, "repeated_id")
    )
    return cut.select(name, "id", "address", problem.alias("problem"))


def parse(lists: DataFrame, text: str = "peers", name: str = "list_id") -> DataFrame:
    """(list_id, valid, n_peers): a list is valid if it has an entry and none of them has a problem."""
    found = entries(lists, text, name).groupBy(name).agg(
        F.count(F.lit(1)).alias("_n"), F.count("problem").alias("_bad")
    )
    joined = lists.select(name).join(found, name, "left")
    valid = F.coalesce((F.col("_n") > 0) & (F.col("_bad") == 0), F.lit(False))
    return joined.select(name, valid.alias("valid"), F.when(valid, F.col("_n")).otherwise(0).cast("bigint").alias("n_peers"))


class Router:
    """Whom a client asks next: the node it believes to lead, else the nodes in turn.

    `call(node)` returns None if the node was not reached, else (success, hint) with a hint of None if unknown.
    """

    def __init__(self, addresses: Mapping[int, str]):
        self.nodes, self.guess, self.turn = list(addresses), None, 0

    def target(self) -> int | None:
        if self.guess in self.nodes:
            return self.guess
        return self.nodes[self.turn % len(self.nodes)] if self.nodes else None

    def write(self, call: Callable[[int], tuple[bool, int | None] | None]) -> list[int]:
        """The nodes asked until one succeeded; raises TimeoutError after MAX_ATTEMPTS."""
        asked: list[int] = []
        while len(asked) < MAX_ATTEMPTS:
            node = self.target()
            if node is None:
                raise LookupError("no nodes are known")
            asked.append(node)
            reply = call(node)
            if reply is None:
                self.turn, self.guess = self.turn + 1, None
            elif reply[0]:
                self.guess = node
                return asked
            else:
                self.guess = reply[1]
        raise TimeoutError(f"no success in {MAX_ATTEMPTS} attempts")

    def read(self, call: Callable[[int], tuple[bool, int | None] | None]) -> int:
        """The first node that answers at all; a plain read follows no hints, and the node that answered is asked next."""
        for _ in range(MAX_ATTEMPTS):
            node = self.target()
            if node is None:
                raise LookupError("no nodes are known")
            if call(node) is not None:
                self.guess = node
                return node
            self.turn, self.guess = self.turn + 1, None
        raise TimeoutError(f"no answer in {MAX_ATTEMPTS} attempts")
