"""Reading fields out of a VARIANT payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import strip


def as_text(value: Column) -> Column:
    """Text form of a variant; JSON null gives null, objects and lists give their JSON."""
    return F.try_variant_get(value, "$", "string")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


class Members:
    """The named members of an object as a struct of variants, read in one pass; null for anything else.

    Names are exact and may hold any sign. Those that differ in case alone go by their places.
    """

    def __init__(self, aliases: list[str]):
        self.names = list(dict.fromkeys(alias.split(".")[0] for alias in aliases))
        unlike = len({name.lower() for name in self.names}) == len(self.names)
        self.fields = self.names if unlike else [f"m{place}" for place in range(len(self.names))]

    def read(self, value: Column, kind: str = "{}") -> Column:
        """A value as such a struct, or with ``kind`` as a type around it, such as ``array<{}>``."""
        read = F.try_variant_get(value, "$", kind.format(_struct(self.names)))
        return read if self.fields is self.names else read.cast(kind.format(_struct(self.fields)))

    def member(self, fields: Column, alias: str) -> Column:
        first, *rest = alias.split(".")
        found = fields[self.fields[self.names.index(first)]]
        for step in rest:
            found = F.try_element_at(F.try_variant_get(found, "$", "map<string,variant>"), F.lit(step))
        return found

    def pick(self, fields: Column, aliases: list[str]) -> Column:
        """The first aliased member that is neither null nor the empty text, as a variant."""
        found = [self.member(fields, alias) for alias in aliases]
        return F.coalesce(*[F.when(_present(member), member) for member in found], F.lit(None).cast("variant"))

    def pick_list(self, fields: Column, aliases: list[str], items: Members) -> Column:
        """As ``pick`` for a list of objects, each as its members in ``items``; a present value that is no list gives
        an empty list, and members that are no objects come out as null."""
        none = F.array().cast(f"array<{_struct(items.fields)}>")
        found = []
        for alias in aliases:
            member = self.member(fields, alias)
            found += [items.read(member, "array<{}>"), F.when(_present(member), none)]
        return F.coalesce(*found, none)


def _struct(names: list[str]) -> str:
    quoted = [name.replace("`", "``") for name in names]
    return "struct<" + ", ".join(f"`{name}`: variant" for name in quoted) + ">"


def _present(member: Column) -> Column:
    return as_text(member) != ""


def vendor_name(value: Column, objects: bool = True) -> Column:
    """Vendor text of a picked value; an object gives its ``name`` when that is non-blank text."""
    unknown = F.lit("Unknown Vendor")
    if not objects:
        return F.coalesce(as_text(value), unknown)
    inner = F.try_variant_get(value, "$['name']", "variant")
    named = F.when(is_text(inner), strip(as_text(inner)))
    name = F.when(is_object(value), named).otherwise(strip(as_text(value)))
    return F.when(name != "", name).otherwise(unknown)
