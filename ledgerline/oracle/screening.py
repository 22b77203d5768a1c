from ledgerline.oracle.kit import using

_COUNTRY = ["% ИРАН %", "% КНДР %", "% СЕВЕРНАЯ КОРЕЯ %", "% КОРЕЙСКАЯ НАРОДНАЯ ДЕМОКРАТИЧЕСКАЯ РЕСПУБЛИКА %"]
_CODE = ["% IRN %", "% PRK %"]
_CREDIT = ["% КРЕДИТ %"] + [f"% {w}% КРЕДИТА %" for w in ("ПОЛУЧЕНИЕ", "ВЫДАЧА", "ПРЕДОСТАВЛЕНИЕ", "РЕСТРУКТУРИЗАЦИЯ")]
_LOAN = ["% ЗАЙМ %"] + [f"% {w}% ЗАЙМА %" for w in ("ПОЛУЧЕНИЕ", "ВЫДАЧА", "ПРЕДОСТАВЛЕНИЕ", "РЕСТРУКТУРИЗАЦИЯ")]


def _hit(x: str, masks: list[str]) -> str:
    cleaned = f"regexp_replace(CONCAT(' ', UPPER({x}), ' '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    return f"CASE WHEN EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({m!r})' for m in masks)}) v(m) WHERE {cleaned} LIKE m) THEN 1 ELSE 0 END"


_CODED = f"""
f AS (SELECT t.*, cf.client_id AS person, cf.full_name, cu.company_name,
        {_hit('t.counterparty_bank_country_code', _CODE)} AS bank, {_hit('t.payment_purpose', _CREDIT)} AS cr,
        {_hit('t.payment_purpose', _LOAN)} AS ln,
        {_hit('cf.tax_registration_country', _CODE)} AS f1, {_hit('cf.registration_address', _COUNTRY)} AS f2,
        {_hit('cf.residential_address', _COUNTRY)} AS f3, {_hit('cf.postal_address', _COUNTRY)} AS f4,
        {_hit('cu.tax_registration_country', _CODE)} AS u1, {_hit('cu.company_address', _COUNTRY)} AS u2,
        {_hit('cu.postal_address', _COUNTRY)} AS u3, {_hit('t.location', _COUNTRY)} AS l1
      FROM transactions t LEFT JOIN client_persons cf ON t.client_id = cf.client_id
      LEFT JOIN client_companies cu ON t.client_id = cu.client_id),
m AS (SELECT *, (CASE WHEN bank = 1 THEN 1 ELSE 0 END) + (CASE WHEN cr = 1 AND ln = 0 THEN 2 ELSE 0 END) + ln * 4
             + (CASE WHEN person IS NOT NULL THEN 8 ELSE 16 END) + 4096 AS tm,
             (CASE WHEN f1 + f2 + u1 + u2 > 0 THEN 1 ELSE 0 END) + (CASE WHEN f3 > 0 THEN 2 ELSE 0 END)
             + (CASE WHEN f4 + u3 + l1 > 0 THEN 4 ELSE 0 END) AS lm FROM f)"""
_V = ("transactions", "client_persons", "client_companies")
_BANK = "Банк-корреспондент зарегистрирован в стране, не участвующей в международном сообществе ПОД/ФТ."
_PLACE = ["зарегистрирован(-о,-а)", "проживает", "зарегистрирован(-о,-а) и проживает", "находится",
          "зарегистрирован(-о,-а) и находится", "проживает и находится",
          "зарегистрирован(-о,-а), проживает и находится"]

SQL = {
    "aml_list_flags": using("transactions") + f"""
        SELECT operation_id, {_hit('location', _COUNTRY)} AS in_country_list,
               {_hit('counterparty_bank_country_code', _CODE)} AS in_country_code_list,
               {_hit('payment_purpose', _CREDIT)} AS is_credit, {_hit('payment_purpose', _LOAN)} AS is_loan
        FROM transactions""",
    "aml_trigger_mask": using(*_V, rest=_CODED) + "SELECT operation_id, CAST(tm AS INTEGER) AS trigger_text_mask FROM m",
    "aml_location_mask": using(*_V, rest=_CODED) + "SELECT operation_id, CAST(lm AS INTEGER) AS location_mask FROM m",
    "aml_alerts": using(*_V, rest=_CODED) + f"""
        SELECT concat_ws(' ', CASE WHEN bank = 1 THEN '{_BANK}' END,
                 CASE WHEN lm > 0 AND ln = 0 THEN 'Получатель кредита' END,
                 CASE WHEN lm > 0 AND ln = 1 THEN 'Займодавец либо заемщик' END,
                 CASE WHEN lm > 0 THEN CASE WHEN person IS NOT NULL THEN '(физ. лицо или ИП)' ELSE '(юр. лицо)' END END,
                 CASE lm {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLACE, 1))} END,
                 CASE WHEN lm > 0 THEN 'в стране, не участвующей в международном сообществе ПОД/ФТ.' END) AS message,
               operation_id, COALESCE(full_name, company_name) AS client_name, operation_amount, currency
        FROM m WHERE CASE WHEN UPPER(currency) LIKE '%RUB%' THEN operation_amount
                          ELSE operation_amount * TRY_CAST(exchange_rate AS DOUBLE) END >= 600000
          AND regexp_replace(UPPER(operation_status), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') = 'ЗАВЕРШЕНА'
          AND (cr = 1 OR ln = 1) AND (lm > 0 OR bank = 1)""",
    "aml_mask_table": using("transactions") + f"""
        SELECT operation_id, payment_purpose,
               CASE WHEN regexp_matches(UPPER(payment_purpose), 'ДОГОВОР') AND list_has_any(
                        list_transform(range(1200), lambda n: CAST(n AS VARCHAR)),
                        regexp_extract_all(regexp_extract(UPPER(payment_purpose), 'ДОГОВОР.*'), '[^ ,;.!№]+'))
                    THEN 1 ELSE {_hit('payment_purpose', _CREDIT + _LOAN)} END AS hit FROM transactions""",
}
SQL["aml_list_functions"] = SQL["aml_list_flags"]
