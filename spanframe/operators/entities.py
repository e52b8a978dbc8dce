"""Entities of the flat token table: islands of a B and the I of its type, their labels, and label algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.tokens import by_doc

SIGNATURE_LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC", "TITLE_AFFIX")
ONTONOTES = frozenset("ANIMAL CARDINAL DATE EMAIL EVENT FAC GPE LANGUAGE LAW LOC MONEY NORP ORDINAL ORG PERCENT PERSON PHONE PRODUCT QUANTITY TIME URL WORK_OF_ART".split())
_COARSE = {
    "PERSON": "God Person",
    "ORG": "Company Company_Group Corporation_Other Government International_Organization Juridical_Person Juridical_Person_Other Military Nonprofit_Organization Organization Organization_Other Political_Organization Political_Organization_Other Political_Party Pro_Sports_Organization Public_Institution Research_Institute School Show_Organization Sports_League Sports_Organization_Other",
    "GPE": "City Country County Domestic_Region GPE GPE_Other Location_Other Province Region_Other", "ADDRESS": "Address Address_Other Postal_Address", "TITLE": "Position_Vocation Title Title_Other", "MONEY": "Currency Money",
    "PHONE": "Phone_Number", "EMAIL": "Email", "URL": "URL", "DATE": "Date Period_Day Period_Month Period_Week Period_Year", "TIME": "Period_Time Time", "PERCENT": "Percent",
}
COARSE = {fine: coarse for coarse, names in _COARSE.items() for fine in names.split()}


def islands(tokens: DataFrame) -> DataFrame:
    """The tokens of entities with the number of their island in the document; an I that continues nothing is no entity.

    Only tokens that say something of an entity are ordered: the rest goes before any window.
    """
    said = tokens.where("ent_iob in (1, 3) and ent_type <> ''")
    w = by_doc()
    follows = (F.col("ent_iob") == 1) & (F.lag("i").over(w) == F.col("i") - 1) & (F.lag("ent_type").over(w) == F.col("ent_type"))
    x = said.withColumn("island", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # An island's first token is the one that breaks; the others are I of its type.
    x = x.withColumn("first_iob", F.first("ent_iob").over(Window.partitionBy("doc_id", "island").orderBy("i")))
    return x.where("first_iob = 3").drop("first_iob")


def collect(tokens: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(doc_id, text, label, ent_id, start_token, end_token, start_char, end_char), one row for each entity.

    labels: only these; the filter is on the island's type, before any text is put together. None: all; []: none.
    """
    x = islands(tokens)
    if labels is not None:
        keep = compile_labels(labels)
        x = x.where(F.col("ent_type").isin(*keep)) if keep else x.where(F.lit(False))
    ident = F.nullif(F.col("ent_id"), F.lit("")) if "ent_id" in tokens.columns else F.lit(None).cast("string")
    part = F.struct("i", F.concat("text", F.when(F.col("has_space"), " ").otherwise("")).alias("s"), "text")
    g = x.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(part)).alias("p"), F.first("ent_type").alias("label"), F.max_by(ident, -F.col("i")).alias("ent_id"), F.min("i").alias("start_token"), (F.max("i") + 1).alias("end_token"), F.min("idx").alias("start_char"), F.max(F.col("idx") + F.length("text")).alias("end_char"))
    body = F.array_join(F.transform(F.slice("p", 1, F.size("p") - 1), lambda t: t["s"]), "")
    return g.select("doc_id", F.concat(body, F.element_at("p", -1)["text"]).alias("text"), "label", "ent_id", "start_token", "end_token", "start_char", "end_char")


def compile_labels(labels) -> list[str]:
    """Without empty ones, sorted, distinct."""
    return sorted({x for x in labels if x})


def select_labels(requested: list[str], supported: list[str]) -> tuple[list[str], list[str]]:
    """(selected, missing), both in the order of the request, without repetitions and empty labels."""
    asked = list(dict.fromkeys(x for x in requested if x))
    have = set(supported)
    return [x for x in asked if x in have], [x for x in asked if x not in have]


def select_labels_table(requested: DataFrame, supported: DataFrame) -> DataFrame:
    """(label, ord, selected) of tables (label, ord) and (label)."""
    asked = requested.where("label <> ''").groupBy("label").agg(F.min("ord").alias("ord"))
    return asked.join(supported.select("label", F.lit(True).alias("s")).distinct(), "label", "left").select("label", "ord", F.coalesce("s", F.lit(False)).alias("selected"))


def people(entities: DataFrame) -> DataFrame:
    return entities.where("label = 'PERSON'")


def signature(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("label").isin(*SIGNATURE_LABELS))


def check_mapping(mapping: dict[str, str], labels: list[str], name: str = "mapping") -> None:
    """A mapping covers the labels and nothing else, and has no empty targets."""
    if not name:
        raise ValueError("a mapping needs a name")
    if missing := [x for x in labels if x not in mapping]:
        raise ValueError(f"{name} doesn't map {missing}")
    if unknown := [x for x in mapping if x not in labels]:
        raise ValueError(f"{name} maps unknown labels {unknown}")
    if empty := [k for k, v in mapping.items() if not v]:
        raise ValueError(f"{name} maps {empty} to nothing")


def _mapped(label: Column, mapping: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in mapping.items() for x in p]), label) if mapping else F.lit(None).cast("string")


def map_labels(entities: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Labels by the mapping; one that it lacks is an error."""
    to = _mapped(F.col("label"), mapping)
    return entities.withColumn("label", F.coalesce(to, F.raise_error(F.concat(F.lit("no mapping for "), F.col("label")))))


def map_labels_or(entities: DataFrame, mapping: dict[str, str], fallback: str) -> DataFrame:
    return entities.withColumn("label", F.coalesce(_mapped(F.col("label"), mapping), F.lit(fallback)))


def token_labels(tokens: DataFrame, mapping: dict[str, str] | None = None, fallback: str | None = None) -> DataFrame:
    """tokens with bio: B-x, I-x, O, or nothing where nothing is said."""
    label = F.col("ent_type") if mapping is None else F.coalesce(_mapped(F.col("ent_type"), mapping), F.lit(fallback))
    return tokens.withColumn("bio", F.when(F.col("ent_iob") == 3, F.concat(F.lit("B-"), label)).when(F.col("ent_iob") == 1, F.concat(F.lit("I-"), label)).when(F.col("ent_iob") == 2, "O").otherwise(""))


def coarse_label(label: Column) -> Column:
    """The fixed coarse label of a fine one, or null."""
    return _mapped(label, COARSE)


def ontonotes_label(label: Column) -> Column:
    return F.when(label.isin(*sorted(ONTONOTES)), label)


def resolve_coarse(label: Column, exported: dict[str, str]) -> Column:
    """The fixed map first, then an exported one, whose OTHERS is none."""
    return F.coalesce(coarse_label(label), F.nullif(_mapped(label, exported), F.lit("OTHERS")))


def fine_to_coarse(entities: DataFrame, exported: dict[str, str] | None = None) -> DataFrame:
    return entities.withColumn("coarse_label", resolve_coarse(F.col("label"), exported or {}))
