"""Strict JSON reading with field types, on top of Spark's VARIANT."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closes the wrapping array in ``extract``; private-use characters keep it out of real text.
_END = "\uf8f0json-end\uf8f1"


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE")


class Field(NamedTuple):
    """One JSON value as plain columns.

    ``kind`` is STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (JSON null), OBJECT or ARRAY, and
    null when the value is missing. ``text`` and ``number`` are null when they do not apply.
    """

    kind: Column
    text: Column
    number: Column

    @staticmethod
    def of(name: str) -> Field:
        """The field as laid out by ``extract``."""
        return Field(F.col(f"{name}_kind"), F.col(f"{name}_text"), F.col(f"{name}_number"))

    def present(self) -> Column:
        """The field exists and is not JSON null."""
        return F.coalesce(self.kind != "VOID", F.lit(False))

    def is_string(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    def is_number(self) -> Column:
        return F.coalesce(self.kind.isin(*NUMBERS), F.lit(False))

    def truthy(self) -> Column:
        """Present and not one of the empty values ``""``, ``0`` and ``false``."""
        empty = (
            (self.is_string() & (self.text == ""))
            | (self.is_number() & (self.number == 0))
            | ((self.kind == "BOOLEAN") & (self.text == "false"))
        )
        return F.coalesce(self.present() & ~empty, F.lit(False))


def first_present(fields: list[Field]) -> Field:
    """First field that exists and is not JSON null."""

    def pick(part: str) -> Column:
        chosen = None
        for field in fields:
            value = getattr(field, part)
            chosen = (
                F.when(field.present(), value) if chosen is None else chosen.when(field.present(), value)
            )
        return chosen

    return Field(pick("kind"), pick("text"), pick("number"))


def kind_of(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return F.substring_index(F.substring_index(schema, "(", 1), "<", 1)


def parse(df: DataFrame, column: str) -> DataFrame:
    """Add ``_json``: the text parsed as a one-value VARIANT array, null when it is not valid JSON.

    ``try_parse_json`` stops after the first value and ignores what follows, so ``{"a":1} junk``
    would pass. Wrapping the text in an array whose second item is a marker makes any trailing
    text either a syntax error or a third item.

    The result comes out of a one-row generator: Spark moves no later filter below it, so a
    filter on what was parsed does not cause a second parse.
    """
    text = F.col(column)
    wrapped = df.withColumn(
        "_wrapped", F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    )
    whole = (
        (F.try_variant_get("_wrapped", "$[1]", "string") == _END)
        & F.try_variant_get("_wrapped", "$[2]", "variant").isNull()
        & ~text.contains(_END)
    )
    checked = wrapped.withColumn("_checked", F.when(whole, F.col("_wrapped")))
    return checked.select(*df.columns, F.explode(F.array("_checked")).alias("_json"))


def extract(
    df: DataFrame, column: str, names: tuple[str, ...], numbers: tuple[str, ...] = ()
) -> DataFrame:
    """Parse a JSON text column once and lay out its top-level fields as plain columns.

    Adds ``root_kind`` (null when the text is not valid JSON) and, per name, the columns of
    ``Field``; the number only for the names in ``numbers``.
    """
    variants = {f"_{name}": F.try_variant_get("_json", f"$[0].{name}", "variant") for name in names}
    kinds = {f"{name}_kind": kind_of(F.col(f"_{name}")) for name in names}
    kinds["root_kind"] = kind_of(F.try_variant_get("_json", "$[0]", "variant"))
    columns = [F.col(kind) for kind in kinds]
    for name in names:
        value, kind = F.col(f"_{name}"), F.col(f"{name}_kind")
        number = F.lit(None).cast("double")
        if name in numbers:
            number = F.when(kind.isin(*NUMBERS), F.try_variant_get(value, "$", "double"))
        columns += [
            F.when(kind.isNotNull(), F.try_variant_get(value, "$", "string")).alias(f"{name}_text"),
            number.alias(f"{name}_number"),
        ]
    parsed = parse(df, column).withColumns(variants).withColumns(kinds)
    return parsed.select(*df.columns, *columns)
