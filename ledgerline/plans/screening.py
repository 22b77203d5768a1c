"""Mandatory-control screening of transactions: credit or loan, large amount, listed country."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import NON_WORD, bare_word, matches_any, spaced_words
from ledgerline.sources.tables import drop_view, session_view

# Threshold, status, masks and message parts of the scenario.
MAX_AMOUNT = 600_000
RELEVANT_STATUS = "ЗАВЕРШЕНА"
COUNTRY_MASKS = ["% ИРАН %", "% КНДР %", "% СЕВЕРНАЯ КОРЕЯ %", "% КОРЕЙСКАЯ НАРОДНАЯ ДЕМОКРАТИЧЕСКАЯ РЕСПУБЛИКА %"]
COUNTRY_CODE_MASKS = ["% IRN %", "% PRK %"]
CREDIT_MASKS = [
    "% КРЕДИТ %", "% ПОЛУЧЕНИЕ% КРЕДИТА %", "% ВЫДАЧА% КРЕДИТА %", "% ПРЕДОСТАВЛЕНИЕ% КРЕДИТА %",
    "% РЕСТРУКТУРИЗАЦИЯ% КРЕДИТА %",
]
LOAN_MASKS = [
    "% ЗАЙМ %", "% ПОЛУЧЕНИЕ% ЗАЙМА %", "% ВЫДАЧА% ЗАЙМА %", "% ПРЕДОСТАВЛЕНИЕ% ЗАЙМА %",
    "% РЕСТРУКТУРИЗАЦИЯ% ЗАЙМА %",
]
MESSAGE_PARTS = {
    1: "Банк-корреспондент зарегистрирован в стране, не участвующей в международном сообществе ПОД/ФТ.",
    2: "Получатель кредита",
    4: "Займодавец либо заемщик",
    8: "(физ. лицо или ИП)",
    16: "(юр. лицо)",
    32: "зарегистрирован(-о,-а)",
    64: "проживает",
    128: "зарегистрирован(-о,-а) и проживает",
    256: "находится",
    512: "зарегистрирован(-о,-а) и находится",
    1024: "проживает и находится",
    2048: "зарегистрирован(-о,-а), проживает и находится",
    4096: "в стране, не участвующей в международном сообществе ПОД/ФТ.",
}
ALL_BITS = 0xFFFF  # the masks are 16 bits wide
REGISTERED, LIVES, STAYS = 1, 2, 4
FRAGMENT = 3  # characters by which texts and masks of a table find each other, at most


@dataclass(frozen=True)
class Rules:
    """Adjustable parameters of the scenario."""

    max_amount: float = MAX_AMOUNT
    status: str = RELEVANT_STATUS


def in_country_list(place: str) -> Column:
    return matches_any(place, COUNTRY_MASKS)


def in_country_code_list(code: str) -> Column:
    return matches_any(code, COUNTRY_CODE_MASKS)


def is_credit(purpose: str) -> Column:
    return matches_any(purpose, CREDIT_MASKS)


def is_loan(purpose: str) -> Column:
    return matches_any(purpose, LOAN_MASKS)


def _bits(*flags: tuple[Column, int]) -> Column:
    result = F.lit(0)
    for flag, weight in flags:
        result = result.bitwiseOR(flag * weight)
    return result


def person_risk(persons: DataFrame) -> DataFrame:
    """Location bits once per person, before the much larger transactions are met."""
    bits = _bits(
        (in_country_code_list("tax_registration_country"), REGISTERED),
        (in_country_list("registration_address"), REGISTERED),
        (in_country_list("residential_address"), LIVES),
        (in_country_list("postal_address"), STAYS),
    )
    return persons.select("client_id", "full_name", F.lit(True).alias("is_person"), bits.alias("person_bits"))


def company_risk(companies: DataFrame) -> DataFrame:
    bits = _bits(
        (in_country_code_list("tax_registration_country"), REGISTERED),
        (in_country_list("company_address"), REGISTERED),
        (in_country_list("postal_address"), STAYS),
    )
    return companies.select("client_id", "company_name", bits.alias("company_bits"))


def coded(transactions: DataFrame, persons: DataFrame, companies: DataFrame) -> DataFrame:
    """Transactions with client names, the trigger mask and the location mask."""
    credit, loan = F.col("credit"), F.col("loan")
    kind = F.when(F.col("is_person"), 8).otherwise(16)
    only_credit = F.col("bank_listed").bitwiseOR(credit * 2).bitwiseAND(F.bitwise_not(loan * 2))
    trigger = (
        only_credit.bitwiseOR(loan * 4).bitwiseOR(kind).bitwiseOR(F.lit(4096)).bitwiseAND(F.lit(ALL_BITS))
    )
    location = (
        F.coalesce("person_bits", F.lit(0))
        .bitwiseOR(F.coalesce("company_bits", F.lit(0)))
        .bitwiseOR(in_country_list("location") * STAYS)
    )
    return (
        transactions.withColumns(
            {
                "credit": is_credit("payment_purpose"),
                "loan": is_loan("payment_purpose"),
                "bank_listed": in_country_code_list("counterparty_bank_country_code"),
            }
        )
        .join(person_risk(persons), "client_id", "left")
        .join(company_risk(companies), "client_id", "left")
        .withColumns({"trigger_text_mask": trigger, "location_mask": location})
    )


def under_control(rules: Rules = Rules()) -> Column:
    """Conditions on the transaction alone; they are pushed below the client joins."""
    rate = F.col("exchange_rate").try_cast("double")
    in_roubles = F.upper("currency").contains("RUB")
    amount = F.when(in_roubles, F.col("operation_amount")).otherwise(F.col("operation_amount") * rate)
    return (
        (amount >= rules.max_amount)
        & (bare_word("operation_status") == rules.status)
        & ((is_credit("payment_purpose") == 1) | (is_loan("payment_purpose") == 1))
    )


def message(trigger: Column, location: Column) -> Column:
    """Readable text for the set bits, in the order of the bits.

    The location value selects one bit from 32 on; without any location only the bank bit shows.
    """
    place = F.call_function("shiftleft", F.lit(1), location + 4).bitwiseAND(F.lit(ALL_BITS))
    shown = F.when(location == 0, 1).otherwise(ALL_BITS)
    bits = place.bitwiseOR(trigger).bitwiseAND(shown)
    return F.concat_ws(" ", *[F.when(bits.bitwiseAND(F.lit(m)) != 0, text) for m, text in MESSAGE_PARTS.items()])


def alerts(
    transactions: DataFrame, persons: DataFrame, companies: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    risky = (F.col("location_mask") != 0) | (F.col("bank_listed") == 1)
    found = coded(transactions.filter(under_control(rules)), persons, companies).filter(risky)
    return found.select(
        message(F.col("trigger_text_mask"), F.col("location_mask")).alias("message"),
        "operation_id",
        F.coalesce("full_name", "company_name").alias("client_name"),
        "operation_amount",
        "currency",
    )


def list_flags(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "operation_id",
        in_country_list("location").alias("in_country_list"),
        in_country_code_list("counterparty_bank_country_code").alias("in_country_code_list"),
        is_credit("payment_purpose").alias("is_credit"),
        is_loan("payment_purpose").alias("is_loan"),
    )


#: Names of the list tests as SQL functions, and their masks.
LIST_FUNCTIONS = {
    "in_country_list": COUNTRY_MASKS,
    "in_country_code_list": COUNTRY_CODE_MASKS,
    "is_credit": CREDIT_MASKS,
    "is_loan": LOAN_MASKS,
}


@contextmanager
def list_functions(spark: SparkSession) -> Iterator[None]:
    """The four list tests as functions of the session, for use in SQL text; dropped again at the end.

    Spark puts their bodies into the plan of a statement when it is analysed, so frames made inside go on
    working afterwards. A function of that name that is there already is an error, and is left alone.
    """
    made = []
    try:
        for name, masks in LIST_FUNCTIONS.items():
            clean = f"regexp_replace(concat_ws('', ' ', upper(place), ' '), r'{NON_WORD}', ' ')"
            listed = ", ".join(f"'{m}'" for m in masks)
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}(place STRING) RETURNS INT RETURN CAST({clean} LIKE ANY ({listed}) AS INT)")
            made.append(name)
        yield
    finally:
        for name in made:
            spark.sql(f"DROP TEMPORARY FUNCTION {name}")


def list_flags_in_sql(transactions: DataFrame) -> DataFrame:
    """``list_flags`` as SQL text over a session view."""
    spark, name = transactions.sparkSession, f"transactions_{uuid.uuid4().hex}"
    session_view(transactions, name)
    try:
        with list_functions(spark):
            return spark.sql(f"""
                SELECT operation_id, in_country_list(location) AS in_country_list,
                       in_country_code_list(counterparty_bank_country_code) AS in_country_code_list,
                       is_credit(payment_purpose) AS is_credit, is_loan(payment_purpose) AS is_loan
                FROM {name}""")
    finally:
        drop_view(spark, name)


def _fragments(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``_clean, _fragment, _at``: every run of so many characters of a text, and its place."""

    def of(n: int) -> Column:
        places = F.when(F.length("_clean") >= n, F.sequence(F.lit(1), F.length("_clean") - n + 1))
        found = F.transform(places, lambda i: F.struct(F.col("_clean").substr(i, F.lit(n)).alias("_fragment"), i.alias("_at")))
        return F.coalesce(found, F.expr("cast(array() as array<struct<_fragment: string, _at: int>>)"))

    return texts.select("_clean", F.inline(F.concat(*map(of, sizes))))


def file_masks(masks: DataFrame, fragments: DataFrame) -> DataFrame:
    """``_mask, _fragment, _run, _offset``: each mask under its fragment that the texts hold least often.

    Fragments are ``FRAGMENT`` characters of a mask's runs without wildcards, or its longest run where all are
    shorter. A mask with a fragment that no text holds fits none and is left out.
    """
    offsets = F.sequence(F.lit(1), F.length("_run") - F.col("_size") + 1)
    parts = (
        masks.select("_mask", "_size", F.explode(F.split("_mask", "[%_]+")).alias("_run"))
        .filter(F.length("_run") >= F.col("_size"))
        .select("_mask", "_size", "_run", F.explode(offsets).alias("_offset"))
        .withColumn("_fragment", F.col("_run").substr(F.col("_offset"), F.col("_size")))
    )
    counts = fragments.groupBy("_fragment").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_fragment", "_run", "_offset")).alias("best")
    best = parts.join(counts, "_fragment", "left").groupBy("_mask").agg(rarest).filter("best.n > 0")
    return best.select("_mask", "best._fragment", "best._run", "best._offset")


def mask_candidates(texts: DataFrame, masks: DataFrame) -> DataFrame:
    """``_clean, _mask``: pairs that share the mask's rarest fragment, with the whole run around it in its place."""
    sizes = sorted(r["_size"] for r in masks.select("_size").distinct().collect())  # 1 to FRAGMENT
    if not sizes:
        return texts.select("_clean", F.lit(None).cast("string").alias("_mask")).limit(0)
    fragments = _fragments(texts, sizes)
    start = F.col("_at") - F.col("_offset") + 1
    found = fragments.join(file_masks(masks, fragments), "_fragment").filter(start >= 1)
    same = F.col("_clean").substr(start, F.length("_run")) == F.col("_run")
    return found.filter(same).select("_clean", "_mask").distinct()


def flag_by_mask_table(df: DataFrame, text: str, masks: DataFrame, mask: str, out: str) -> DataFrame:
    """Existence test against masks kept in a parameter table of any size.

    Every cleaned text is looked at once. It meets the masks whose rarest fragment it holds (see
    ``file_masks``), then ``LIKE`` decides; fragments that many texts share find no masks unless a mask has no
    other. Masks of wildcards only ask for a length.
    """
    longest = F.array_max(F.transform(F.split("_mask", "[%_]+"), F.length))
    listed = masks.select(F.col(mask).alias("_mask")).filter("_mask is not null").distinct()
    listed = listed.withColumn("_size", F.least(longest, F.lit(FRAGMENT)))
    cleaned = df.withColumn("_clean", spaced_words(text))
    texts = cleaned.select("_clean").filter("_clean is not null").distinct()
    met = mask_candidates(texts, listed.filter("_size > 0")).filter(F.expr("_clean LIKE _mask")).select(F.col("_clean").alias("_hit"))
    free = listed.filter("_size = 0").select(
        F.col("_mask").contains("%").alias("open"), F.length(F.translate("_mask", "%", "")).alias("n")
    )
    exact = free.filter("not open").select("n").distinct()
    least = free.filter("open").agg(F.min("n")).scalar()
    joined = cleaned.join(met.distinct(), F.col("_clean") == F.col("_hit"), "left").join(
        exact, F.length("_clean") == F.col("n"), "left"
    )
    fits = F.col("_hit").isNotNull() | F.col("n").isNotNull() | F.coalesce(F.length("_clean") >= least, F.lit(False))
    return joined.withColumn(out, fits.cast("int")).select(*df.columns, out)


def _coded(t) -> DataFrame:
    return coded(t.transactions, t.client_persons, t.client_companies)


def _mask_table(t) -> DataFrame:
    """The scenario's masks and some thousand contract numbers."""
    listed = t.spark.createDataFrame([(m,) for m in CREDIT_MASKS + LOAN_MASKS], "mask string")
    return listed.union(t.spark.range(1200).select(F.concat(F.lit("%ДОГОВОР% "), "id", F.lit(" %"))))


QUERIES = {
    "aml_list_flags": lambda t: list_flags(t.transactions),
    "aml_list_functions": lambda t: list_flags_in_sql(t.transactions),
    "aml_trigger_mask": lambda t: _coded(t).select("operation_id", "trigger_text_mask"),
    "aml_location_mask": lambda t: _coded(t).select("operation_id", "location_mask"),
    "aml_alerts": lambda t: alerts(t.transactions, t.client_persons, t.client_companies),
    "aml_mask_table": lambda t: flag_by_mask_table(
        t.transactions.select("operation_id", "payment_purpose"), "payment_purpose", _mask_table(t), "mask", "hit"
    ),
}
