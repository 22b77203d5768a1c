"""Car sales: typing, canonical spellings, gated imputation, classes and market figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_even, half_up, percent, ratio, try_number
from ledgerline.functions.text import band, capitalize, replace_whole
from ledgerline.operators.cleaning import (
    ModeGate,
    assign_where,
    canonicalize,
    class_audit,
    fill_own_mode,
    impute_modes,
    null_analysis,
    reclassify,
    reconcile,
    reset_where,
    set_own_mode,
    unknown_members,
    with_row_id,
)
from ledgerline.operators.profile import column_profile, duplicate_report, share, top_values
from ledgerline.operators.relational import share_of_total, top_k
from ledgerline.session import durable

# Month names of the sales year, placeholders, spellings.
MONTHS = {
    "Январь": 1, "Февраль": 2, "Март": 3, "Апрель": 4, "Май": 5, "Июнь": 6, "Июль": 7, "Август": 8, "Сентябрь": 9,
}
NO_VALUE = ["#Н/Д", "0"]
YEARS = {"2\xa0018": "2018", "2\xa0019": "2019"}  # the only spellings that are repaired
COUNTRIES = {
    "Казахстан": ["Республика Казахстан"],
    "Россия": ["Российская Федерация"],
    "Великобритания": ["UK"],
}
CAR_TYPES = {"Внедорожники": ["Пикапы"], "Легковые автомобили": ["Минивэны"]}
GEARBOXES = {
    "MT": ["M", "M/T", "MT", "М", "М/T", "МT", "МКП", "МКПП", "МТ", "Мех."],
    "AT": ["А", "А/T", "АT", "АКП", "АКПП", "АТ", "G-TRONIC", "AT", "A", "A/T", "Tiptronic", "Steptronic",
           "АКППTiptronicS", "-ступАКПП"],
    "AMT": ["PDK", "PowershiftS", "S-Tronic", "АКПП(PDK)", "АКППPDK", "DCT", "DSG", "AMT", "S-tronic"],
    "CVT": ["CVT", "CVT(вAриATор)", "CVT(вариATор)", "CVT(вариатор)"],
    "Редуктор": ["РЕДУКТОР"],
}
NO_GEARBOX = ["TDI", "Передний", "#Н/Д", "WD", ""]
DRIVES = {
    "2WD": ["2 WD", "2WD", "4X2", "4x2", "4х2", "4х2.2"],
    "FWD": ["FF", "FWD", "Передний", "Передний (FF)", "передний"],
    "RWD": ["RWD", "Задний"],
    "4WD": ["4WD", "4 WD", "4Motion", "4X4", "4x4", "4х4", "quattro", "Полный", "полный"],
    "AWD": ["AWD"],
}
NO_DRIVE = ["#Н/Д", "0", "Астана"]
DEALERS = {"Auto Trader": ["Auto trader"]}
CUSTOMERS = {
    "Физическое лицо": ["Физ. Лицо", "ФизЛицо", "физ.лицо", "физическое"],
    "Юридическое лицо": ["Юр. Лицо", "Юр.Лицо", "ЮрЛицо", "юридическое", "Корп. клиент"],
}
PAYMENTS = {
    "В кредит": ["кредит", "Отсрочка платежа", "лизинг", "обмен+кредит", "trade-in"],
    "Наличный расчёт": [
        "Без.Наличный", "Безналичная", "Безналичная ", "Перечисление", "б/н", "безналичный", "безналичный ",
        "перечислением", "обмен+нал", "нал", "наличные", "наличный", "Наличная",
        "Акция Собственные средства (Trade in 5%)", "Собственные средства",
    ],
}
NOT_PAID = ["Без оплаты"]
PERSON, FIRM = "Физическое лицо", "Юридическое лицо"
PETROL, ELECTRIC = "Бензин", "Электричество"
WRONG_SALE = (0, -35588)


def purchase_date(year: str = "year", month: str = "month") -> Column:
    """First day of the month named in words; unknown names give null."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.col(month))
    return F.make_date(F.col(year), number, F.lit(1))


def _displacement(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, ",", "."), r"[^0-9.]", "")
    return F.nullif(F.btrim(plain, F.lit(".")), F.lit("")).try_cast("double")


def typed(cars: DataFrame) -> DataFrame:
    return cars.withColumns(
        {
            "purchase_date": purchase_date(),
            "model": F.btrim("model"),
            "manufacturing_year": replace_whole("manufacturing_year", YEARS).try_cast("bigint"),
            "engine_displacement_l": _displacement(F.col("engine_displacement_l")),
            "price_usd": half_even(try_number("price_usd")).cast("bigint"),
            "sale_usd": half_even(try_number("sale_usd")).cast("bigint"),
        }
    ).drop("year", "month")


def canonical(cars: DataFrame) -> DataFrame:
    """One spelling per value of the named columns; misplaced values moved; impossible ones repaired."""
    moved = cars.withColumn(
        "engine_displacement_l",
        F.when(F.col("fuel_type").isin("2", "1,6"), F.translate("fuel_type", ",", ".").cast("double")).otherwise(
            F.col("engine_displacement_l")
        ),
    )
    compact = moved.withColumn("fuel_type", F.translate(capitalize("fuel_type"), " ", ""))
    spelled = canonicalize(compact, "fuel_type", {ELECTRIC: ["Электро"], PETROL: ["2", "1,6", "0"]})
    companies = {"Astana Motors": ["ТОО Astana Motors", "Astana  Motors", "astana motors"]}
    named = canonicalize(spelled, "company", companies, NO_VALUE)
    named = canonicalize(named, "manufacturing_country", COUNTRIES)
    digits = F.translate("transmission_type", " 0123456789", "")
    named = canonicalize(named.withColumn("transmission_type", digits), "transmission_type", GEARBOXES, NO_GEARBOX)
    named = canonicalize(named, "drive_type", DRIVES, NO_DRIVE)
    named = canonicalize(named, "car_type", CAR_TYPES)
    dealer = F.replace(F.btrim("dealer", F.lit(" ")), F.lit("\xa0"), F.lit(" "))
    named = canonicalize(named.withColumn("dealer", dealer), "dealer", DEALERS)
    named = canonicalize(named, "customer_type", CUSTOMERS)
    named = canonicalize(named, "payment_form", PAYMENTS, NOT_PAID)
    named = named.withColumn("quantity", F.when(F.col("quantity") == -1, 1).otherwise(F.col("quantity")))
    electric = F.coalesce(F.col("fuel_type") == ELECTRIC, F.lit(False))
    named = named.withColumn("transmission_type", F.when(electric, "Редуктор").otherwise(F.col("transmission_type")))
    real_sale = F.when(F.col("sale_usd").isin(*WRONG_SALE), F.col("price_usd")).otherwise(F.col("sale_usd"))
    return named.withColumns(
        {
            "sale_usd": real_sale,
            "engine_displacement_l": F.when(
                F.coalesce(F.col("fuel_type") != ELECTRIC, F.lit(True)), F.col("engine_displacement_l")
            ),
        }
    )


def imputed(cars: DataFrame) -> DataFrame:
    """Mode per brand and model where it is frequent enough; four columns in one pass."""
    gates = {
        "manufacturing_year": ModeGate(60.0),
        "fuel_type": ModeGate(60.0),
        "engine_displacement_l": ModeGate(60.0, 90.0),
        "transmission_type": ModeGate(100.0, 90.0),
    }
    return impute_modes(cars, gates, ["brand", "model"])


def overridden(cars: DataFrame) -> DataFrame:
    """Hand-made rules, in order; one of them sets two columns from the row as it was."""
    no_gearbox = F.col("transmission_type").isNull()
    odd = (F.col("model") == "M5") & F.col("engine_displacement_l").isin(2.0, 2.5)
    rules = [
        (no_gearbox & (F.col("brand") == "Brand 3"), {"transmission_type": F.lit("AT")}),
        (no_gearbox & F.col("model").isin("M10", "M20"), {"transmission_type": F.lit("MT")}),
        (odd, {"drive_type": F.lit("FWD"), "engine_displacement_l": F.lit(1.6)}),
    ]
    return assign_where(cars, rules)


# Member lists are parameters; these fit the test table.
FRONT, REAR, ALL_WHEELS, OWN_MODE = ["M9", "M18"], ["M27", "M36"], ["M45"], ["M5", "M14", "M23", "M6", "M7"]


def drives_filled(cars: DataFrame) -> DataFrame:
    """Two-wheel drives made exact by member lists, then nulls by lists and by the member's own mode."""
    two, unknown, model = F.col("drive_type") == "2WD", F.col("drive_type").isNull(), F.col("model")
    rules = [(two & model.isin(m), F.lit(d)) for d, m in (("FWD", FRONT), ("RWD", REAR), ("4WD", ALL_WHEELS))]
    exact = reset_where(cars, "drive_type", rules)
    filled = reset_where(exact, "drive_type", [(unknown & model.isin("M8", "M17"), F.lit("FWD"))])
    return fill_own_mode(filled, "drive_type", "model", OWN_MODE)


def customer_filled(cars: DataFrame) -> DataFrame:
    """One car: a person; several: a firm; no quantity: one car and a person."""
    unknown = F.col("customer_type").isNull()
    rules = [
        (unknown & (F.col("quantity") == 1), F.lit(PERSON)),
        (unknown & (F.col("quantity") > 1), F.lit(FIRM)),
        (F.col("quantity").isNull(), F.lit(PERSON)),
    ]
    return reset_where(cars, "customer_type", rules).na.fill(1, ["quantity"])


# Models whose displacement is known to be one and the same; they fit the test table.
ONE_ENGINE = ["M5", "M12", "M33"]


def reclassified(t) -> tuple[DataFrame, DataFrame]:
    """Cars before and after the class rules: sizes by model, lorries by model and displacement."""
    cars = _canonical(t).select("model", "car_classification", "engine_displacement_l")
    return cars, reclassify(cars, t.class_rules, "model", "car_classification", "engine_displacement_l")


def monthly_revenue(cars: DataFrame) -> DataFrame:
    return cars.groupBy("purchase_date", "car_type").agg(
        F.sum("sale_usd").alias("revenue"), F.sum("quantity").alias("cars")
    )


PRICE_BANDS = [(10_000.0, "до 10"), (30_000.0, "10-30"), (60_000.0, "30-60")]


def price_bands(cars: DataFrame) -> DataFrame:
    counts = cars.groupBy(band("price_usd", PRICE_BANDS, "свыше 60").alias("price_band")).agg(
        F.count("*").alias("sales")
    )
    return share_of_total(counts, "sales", "share")


def top_models_by_class(cars: DataFrame, k: int = 3) -> DataFrame:
    counts = cars.groupBy("car_classification", "model").agg(F.count("*").alias("sales"))
    best = Window.partitionBy("car_classification").orderBy(F.desc("sales"), F.asc("model"))
    return counts.withColumn("place", F.row_number().over(best).cast("bigint")).filter(F.col("place") <= k)


def top_by(cars: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = cars.groupBy(column).agg(F.count("*").alias("sales"), F.sum("sale_usd").alias("revenue"))
    return top_k(counts, k, F.desc("revenue"), F.asc(column))


def local_share(cars: DataFrame) -> DataFrame:
    return cars.groupBy("purchase_date").agg(share(F.col("assembly") == "Местное").alias("local_percent"))


def dealers_per_company(cars: DataFrame) -> DataFrame:
    pairs = cars.select("company", "dealer").distinct()
    return pairs.groupBy("company").agg(F.count("dealer").alias("dealers"))


def specialisation(cars: DataFrame, kind: str = "Коммерческие") -> DataFrame:
    """Companies by whether they sell only, also or never the given car type."""
    return cars.groupBy("company").agg(
        F.when(F.every(F.col("car_type") == kind), "only")
        .when(F.some(F.col("car_type") == kind), "mixed")
        .otherwise("none")
        .alias("sells")
    )


def company_efficiency(cars: DataFrame) -> DataFrame:
    """Revenue per dealer and per sold car."""
    dealers = dealers_per_company(cars)
    sums = cars.groupBy("company").agg(F.sum("sale_usd").alias("revenue"), F.sum("quantity").alias("cars"))
    return sums.join(dealers, sums["company"].eqNullSafe(dealers["company"])).select(
        sums["company"],
        half_up(ratio("revenue", "dealers"), 2).alias("revenue_per_dealer"),
        half_up(ratio("revenue", "cars"), 2).alias("revenue_per_car"),
    )


def customer_by_quantity(cars: DataFrame, kinds: Sequence[str] = (PERSON, FIRM)) -> DataFrame:
    """Cross-table of quantity and customer type with the rows lacking a type."""
    wide = (
        cars.na.drop(subset=["quantity"])
        .na.fill("null_cnt", ["customer_type"])
        .groupBy("quantity")
        .pivot("customer_type", [*kinds, "null_cnt"])
        .count()
        .na.fill(0)
    )
    all_rows = F.col("persons") + F.col("firms") + F.col("null_cnt")
    return wide.toDF("quantity", "persons", "firms", "null_cnt").select(
        "*", all_rows.alias("obs_cnt"), percent("null_cnt", all_rows, 1).alias("null_perc")
    )


def _canonical(t) -> DataFrame:
    return canonical(typed(t.cars))


IMPUTED = [
    "brand", "model", "manufacturing_year", "fuel_type", "engine_displacement_l", "transmission_type", "price_usd", "dealer",
]
KEY = ["purchase_date", "brand", "model", "city", "dealer", "price_usd"]

QUERIES = {
    "car_types": lambda t: typed(t.cars),
    "car_duplicates": lambda t: duplicate_report(typed(t.cars)),
    "car_key": lambda t: with_row_id(typed(t.cars).select(*KEY), KEY),
    "car_profile": lambda t: column_profile(typed(t.cars), ["company", "brand", "model", "fuel_type"]),
    "car_top_values": lambda t: top_values(typed(t.cars), ["company", "brand", "model", "fuel_type"], 5),
    "car_canonical": lambda t: _canonical(t).select(
        "company", "manufacturing_country", "fuel_type", "engine_displacement_l", "price_usd", "sale_usd", "model",
        "car_type", "transmission_type", "drive_type", "dealer", "customer_type", "payment_form", "quantity",
    ),
    "car_drives": lambda t: drives_filled(_canonical(t)).groupBy("model", "drive_type").agg(F.count("*").alias("cnt")),
    "car_null_analysis": lambda t: null_analysis(_canonical(t), "manufacturing_year", ["brand", "model"]),
    "car_reconcile": lambda t: reconcile(_canonical(t), "manufacturing_year", ["brand", "model"]),
    "car_impute": lambda t: imputed(durable(_canonical(t).select(*IMPUTED))),
    "car_overrides": lambda t: overridden(_canonical(t)).select(
        "brand", "model", "transmission_type", "drive_type", "engine_displacement_l"
    ),
    "car_customer_crosstab": lambda t: customer_by_quantity(_canonical(t)),
    "car_customer_rule": lambda t: customer_filled(_canonical(t)).groupBy("quantity", "customer_type").agg(
        F.count("*").alias("cnt")
    ),
    "car_reclass": lambda t: class_audit(*reclassified(t), "model", "car_classification"),
    "car_reclass_typos": lambda t: unknown_members(_canonical(t), "model", t.class_rules),
    "car_real_displacement": lambda t: set_own_mode(_canonical(t), "engine_displacement_l", "model", ONE_ENGINE)
    .groupBy("model", "engine_displacement_l")
    .agg(F.count("*").alias("cnt")),
    "car_market_monthly": lambda t: monthly_revenue(_canonical(t)),
    "car_market_price_bands": lambda t: price_bands(_canonical(t)),
    "car_market_top_models": lambda t: top_models_by_class(_canonical(t)),
    "car_market_brands": lambda t: top_by(_canonical(t), "brand"),
    "car_market_cities": lambda t: top_by(_canonical(t), "city"),
    "car_market_local_share": lambda t: local_share(_canonical(t)),
    "car_market_dealers": lambda t: dealers_per_company(_canonical(t)),
    "car_market_specialisation": lambda t: specialisation(_canonical(t)),
    "car_market_efficiency": lambda t: company_efficiency(_canonical(t)),
}
