"""Heritage register: sparse columns, JSON columns, dates and construction-date spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.jsontext import first_item, item_rows, json_columns, json_get, longest_array, numbered_items
from ledgerline.functions.text import lower_except, replace_in_order
from ledgerline.operators.cleaning import canonicalize, normalize_columns, prune_sparse
from ledgerline.operators.profile import before_after, null_profile, value_counts

# Spellings of construction dates, each list goes to one form.
ROMAN = "IXVХ"  # the last letter is the Cyrillic one
SPELLINGS = {
    "III тыс. до н.э. - XIV в. н.э.": [
        "III тыс. до н. э. - XIV в. н. э.", "III тыс. до н. э. -  XIV в. н. э.", "III тыс. до н.э.-XIV в. н.э.",
        "III тыс. до н.э. - XIV в. н. э.", "III тыс. до н.э. - XIV вв. н.э.", "III тыс. до н.э. - XIV в.н.э.",
        "III тыс. до н.э. – XIV в. н.э.", "III тыс. до н.э. -  XIV в. н.э.", "III тыс. до н.э. -  XIV в.н.э.",
        "третье тысячелетие до н.э. - XIV в. н.э.",
    ],
    "XVIII в.": ["XVIII век"],
    "кон. XVIII-нач. XIX вв.": ["конец XVIII-начало XIX вв."],
    "XVIII-XIX вв.": ["XVIII - XIX вв."],
    "XIX в.": ["XIX век"],
    "сер. XVIII в.": ["середина XVIII в."],
    "2-я пол. XVIII в.": ["вторая половина XVIII в."],
    "1-я пол. XIX в.": ["первая половина XIX в.", "пер. пол. XIX в.", "I пол. XIX в."],
    "2-я пол. XIX в.": [
        "вторая половина XIX века", "2-я половина XIX в.", "II пол. XIX в.", "вт. пол. XIX в.",
        "вторая половина XIX в.",
    ],
    "нач. XIX в.": ["начало XIX века"],
    "сер. XIX в.": ["середина XIX века"],
    "кон. XIX в.": ["конец XIX века", "к. XIX в."],
    "кон. XIX - нач. XX вв.": ["кон. XIX-нач. XX вв.", "конец XIX - начало ХХ вв.", "конец XIX-начало XX века"],
    "нач. XX в.": ["нач. ХХ в.", "начало XX века", "начало ХХ века", "начало ХХ в.", "н. XX в."],
    "средневековье": ["средние века", "эпоха средневековья"],
    "бронзовый век": ["эпоха бронзы"],
    "1942-1943 гг.": ["1942 - 1943 годы"],
    "III-II тыс. до н.э.": ["III - II тыс. до н.э."],
    "XIV-XVI вв.": ["XIV - XVI вв."],
    "железный век": ["эпоха железа"],
    "неолит": ["эпоха неолита"],
    "ранний железный век": ["эпоха раннего железа"],
    "1941-1945 гг.": ["1941-1943 гг.", "1941-1944 гг.", "1942-1943 гг.", "1941 - 1943 гг."],
    "1944 г.": ["1944 год"],
    "дата создания (возникновения) не определена": ["-"],
    "XII-XVI вв.": ["XII - XVI вв."],
    "XVIII-XX вв.": ["XVIII – XX вв."],
    "палеолит": ["эпоха палеолита"],
    "позднее средневековье": ["эпоха позднего средневековья"],
    "поздний бронзовый век": ["эпоха поздней бронзы"],
}
# Replacements inside the text, in order; True marks patterns, where a dot is any character.
PART_RULES = [
    (" - ", "-", False), (" – ", " -", False), ("год", "г.", False), ("Х", "X", False), ("г.ы", "гг.", True),
    ("начало", "нач.", False), ("середина", "сер.", False), ("половина", "пол.", False), ("2 -я", "2-я", False),
    ("2- я", "2-я", False), ("вторая", "2-я", False), ("2 пол.", "2-я пол", True), ("II пол.", "2-я пол", True),
    ("2-ая", "2-я", False), ("II-я пол.", "2-я пол", True), ("1 -я", "1-я", False), ("1- я", "1-я", False),
    ("первая", "1-я", False), ("1 пол.", "1-я пол", True), ("I пол.", "1-я пол", True),
    ("I-я пол.", "1-я пол", True), ("1-ая", "1-я", False), ("четверть", "четв.", False),
    ("I1-я пол", "2-я пол.", False),
]
# First and last day the register's date type can hold.
EARLIEST, LATEST = "1677-09-22", "2262-04-11"


# Spellings of whole values in three more columns.
NOT_APPROVED = {
    "Предмет охраны не утверждён": [
        "не утвержден", "Не утвержден.", "Не утвержден", "Предмет охраны не утвержден.", "Предмет охраны не утвержден",
    ],
}
BORDERS = {
    "Границы территории не утверждены": [
        "Не утверждены.", "не утверждены", "Границы территории не утверждены.", "Не утверждены",
    ],
}
WHOLE_VALUES = {
    "object": {"Жилой дом": ["Дом жилой"]},
    "object_description": NOT_APPROVED,
    "object_border_description": BORDERS,
}


def normalized(register: DataFrame, column: str = "construction_date") -> DataFrame:
    """Lower-cased but for Roman numerals, one spelling per date; the text 'nan' is null.

    Separate steps, so that no step's expression is repeated inside the next one.
    """
    lowered = register.withColumn(column, lower_except(column, ROMAN))
    spelled = canonicalize(lowered, column, SPELLINGS, ["nan"])
    result = F.col(column)
    for pattern, replacement, is_regex in PART_RULES:
        result = replace_in_order(result, [(pattern, replacement)], is_regex)
    return spelled.withColumn(column, F.btrim(result, F.lit(" ")))


def normalized_all(register: DataFrame) -> DataFrame:
    """Dates and the three columns whose variants are whole values."""
    named = normalized(normalize_columns(register, {"объект": "object"}))
    for column, variants in WHOLE_VALUES.items():
        named = canonicalize(named, column, variants)
    return named


def coerced_date(text: str) -> Column:
    """Date or null: unreadable, impossible and out-of-range dates are null."""
    day = F.col(text).try_cast("date")
    return F.when(day.between(F.lit(EARLIEST).cast("date"), F.lit(LATEST).cast("date")), day)


def with_map_columns(register: DataFrame) -> DataFrame:
    wide = json_columns(register.select("id", "map_json"), "map_json", "coordinates array<bigint>, type string")
    return wide.select("id", F.to_json("coordinates").alias("coordinates"), "type")


def with_kind(register: DataFrame) -> DataFrame:
    return register.select(
        "id", first_item("kind_json", "id").alias("kind_id"), first_item("kind_json", "value").alias("kind_value")
    )


def with_documents(register: DataFrame) -> DataFrame:
    """Columns for as many documents as the longest list has."""
    size = longest_array(register, "docs_json")
    return register.select("id", *numbered_items("docs_json", ["name"], {"archive": ["id", "url"]}, size))


def document_rows(register: DataFrame) -> DataFrame:
    rows = item_rows(register, "id", "docs_json", "name string, archive struct<id:string, url:string>")
    return rows.select("id", "position", "name", F.col("archive.id").alias("archive_id"))


def with_image(register: DataFrame) -> DataFrame:
    return register.select(
        "id", json_get("image_json", "url").alias("url"), json_get("image_json", "title").alias("title")
    )


def selected(register: DataFrame) -> DataFrame:
    """Renamed and reordered columns without the raw JSON."""
    named = normalize_columns(register, {"объект": "object", "doc_date": "document_date"})
    slim = named.drop("map_json", "kind_json", "docs_json", "image_json", "sparse_95", "all_null")
    return slim.select("id", "object", "kind", "construction_date", "document_date")


def archaeology(register: DataFrame) -> DataFrame:
    """Rows whose kind mentions archaeology; an unknown kind does not."""
    return register.filter(F.coalesce(F.col("kind").contains("археологии"), F.lit(False)))


QUERIES = {
    "her_prune": lambda t: prune_sparse(t.heritage, 0.9),
    "her_prune_all_null": lambda t: prune_sparse(t.heritage, 1.0).drop("map_json", "docs_json"),
    "her_json_object": lambda t: with_map_columns(t.heritage),
    "her_json_event_props": lambda t: json_columns(t.events.select("event_id", "props"), "props", "k bigint"),
    "her_json_first": lambda t: with_kind(t.heritage),
    "her_json_numbered": lambda t: with_documents(t.heritage),
    "her_json_rows": lambda t: document_rows(t.heritage),
    "her_json_image": lambda t: with_image(t.heritage),
    "her_select": lambda t: selected(t.heritage),
    "her_dates": lambda t: t.heritage.select("id", coerced_date("doc_date").alias("document_date")),
    "her_nulls": lambda t: null_profile(t.heritage),
    "her_nulls_archaeology": lambda t: null_profile(archaeology(t.heritage)),
    "her_normalize": lambda t: normalized_all(t.heritage).select("id", "construction_date", *WHOLE_VALUES),
    "her_value_counts": lambda t: value_counts(normalized(t.heritage), "construction_date"),
    "her_before_after": lambda t: before_after(
        t.heritage, normalized(t.heritage), ["construction_date", "kind"]
    ),
}
