"""Screening: every location value, client kinds and message texts against plain Python rules."""

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import screening

T = ("operation_id string, client_id string, operation_amount double, currency string, exchange_rate string, "
     "operation_status string, payment_purpose string, location string, counterparty_bank_country_code string")
FL = ("client_id string, full_name string, tax_registration_country string, residential_address string, "
      "registration_address string, postal_address string")
UL = "client_id string, company_name string, tax_registration_country string, company_address string, postal_address string"


@pytest.fixture()
def clients(spark):
    places = [(r, v, s) for r in (0, 1) for v in (0, 1) for s in (0, 1)]
    persons = [(f"p{r}{v}{s}", "Имя", None, "Иран" if v else None, "г. КНДР," if r else None, "иран" if s else "x")
               for r, v, s in places]
    companies = [("u1", "Фирма", "PRK", None, None), ("u2", "Фирма", "USA", "Северная Корея", "Иран")]
    return spark.createDataFrame(persons, FL), spark.createDataFrame(companies, UL)


def op(i, client, amount=600000.0, currency="RUB", rate=None, status="завершена.", purpose="Кредит", place=None, bank="USA"):
    return (str(i), client, amount, currency, rate, status, purpose, place, bank)


def test_location_values(spark, clients):
    names = [f"p{r}{v}{s}" for r in (0, 1) for v in (0, 1) for s in (0, 1)] + ["u1", "u2", "nobody"]
    rows = spark.createDataFrame([op(n, n) for n in names], T)
    got = {r.operation_id: r.location_mask for r in screening.coded(rows, *clients).collect()}
    want = {f"p{r}{v}{s}": r + 2 * v + 4 * s for r in (0, 1) for v in (0, 1) for s in (0, 1)}
    assert got == {**want, "u1": 1, "u2": 5, "nobody": 0}


def test_trigger_values(spark, clients):
    cases = {
        "credit": (op("credit", "p000"), 2 + 8 + 4096),
        "loan": (op("loan", "u1", purpose="выдача займа"), 4 + 16 + 4096),
        "both": (op("both", "nobody", purpose="займ и кредит"), 4 + 16 + 4096),
        "bank": (op("bank", "p000", bank="irn", purpose=None), 1 + 8 + 4096),
    }
    rows = spark.createDataFrame([c[0] for c in cases.values()], T)
    got = {r.operation_id: r.trigger_text_mask for r in screening.coded(rows, *clients).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_conditions(spark, clients):
    rows = [
        op("exact", "p100"), op("below", "p100", 599999.99), op("foreign", "p100", 300000.0, "USD", "2"),
        op("badrate", "p100", 900000.0, "USD", "n/a"), op("status", "p100", status="отклонена"),
        op("purpose", "p100", purpose="аренда"), op("safe", "p000"), op("place", "p000", place="(Иран)"),
        op("bank", "nobody", bank=" PRK "),
    ]
    found = screening.alerts(spark.createDataFrame(rows, T), *clients)
    assert {r.operation_id for r in found.collect()} == {"exact", "foreign", "place", "bank"}


def test_messages(spark, clients):
    rows = [op("a", "p110"), op("b", "nobody", bank="PRK"), op("c", "u2", purpose="займ")]
    got = {r.operation_id: (r.message, r.client_name) for r in screening.alerts(spark.createDataFrame(rows, T), *clients).collect()}
    end = "в стране, не участвующей в международном сообществе ПОД/ФТ."
    assert got == {
        "a": (f"Получатель кредита (физ. лицо или ИП) зарегистрирован(-о,-а) и проживает {end}", "Имя"),
        "b": (screening.MESSAGE_PARTS[1], None),
        "c": (f"Займодавец либо заемщик (юр. лицо) зарегистрирован(-о,-а) и находится {end}", "Фирма"),
    }


def test_mask_table_of_any_size(spark):
    masks = spark.range(3000).select(F.concat(F.lit("% "), "id", F.lit(" %")).alias("mask"))
    masks = masks.union(spark.createDataFrame([("%Q_X%",), ("% %АБВ %ГД% %",), (None,)], "mask string"))
    texts = ["a 3 b", "7", "3001", "2999.", "qzx", "q x y", "где абв, гд!", "абвгд", "", None, "a 3 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = screening.flag_by_mask_table(rows, "x", masks, "mask", "hit").collect()
    assert sorted((r.x or "", r.hit) for r in got) == sorted(
        zip([t or "" for t in texts], [1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1])
    )


def test_masks_are_filed_under_their_rarest_fragment(spark):
    """Contract masks share a word that all texts hold; each text meets one or two of them, not all."""
    masks = spark.range(1200).select(F.concat(F.lit("%ДОГОВОР% "), "id", F.lit(" %")).alias("_mask")).withColumn("_size", F.lit(3))
    texts = spark.range(500).select(F.concat(F.lit(" АРЕНДА ДОГОВОР "), (F.col("id") * 7 % 2000).cast("string"), F.lit(" ")).alias("_clean"))
    pairs = screening.mask_candidates(texts, masks)
    filed = screening.file_masks(masks, screening._fragments(texts, [3]))
    assert filed.filter("_fragment IN (' ДО', 'ДОГ', 'ОГО', 'ГОВ', 'ОВО', 'ВОР', 'ОР ')").count() == 0
    assert filed.groupBy("_fragment").count().agg(F.max("count")).first()[0] <= 40
    assert pairs.count() <= 2 * 500
    right = {t for t in (i * 7 % 2000 for i in range(500)) if t < 1200}
    assert pairs.filter("_clean LIKE _mask").select("_clean").distinct().count() == len(right)


def test_masks_without_long_runs(spark):
    cases = {"%": 0, "_%_": 0, "____": 0, "%A_B%": 0, "_ Q _": 0, "%ZZ%": 0, "": 0}
    texts = ["a b", "q", "ab", "azb", "zz", "a", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for mask in cases:
        masks = spark.createDataFrame([(mask,), ("%NEVER THERE%",)], "mask string")
        got = screening.flag_by_mask_table(rows, "x", masks, "mask", "hit")
        like = rows.withColumn("clean", screening.spaced_words("x")).withColumn(
            "want", F.coalesce(F.expr("clean LIKE '" + mask + "'").cast("int"), F.lit(0))
        )
        assert sorted((r.x or "-", r.hit) for r in got.collect()) == sorted((r.x or "-", r.want) for r in like.collect()), mask
