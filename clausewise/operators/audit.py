"""The contract audit: ten groups of rules as Catalyst expressions over one text column.

Each rule is an expression of type array<struct<rule_id, description, found_text>>; the rules of a
document are concatenated in a single projection, so an audit reads the text once, in the JVM,
without a shuffle. Reports on top of it explode and aggregate.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, between, index_of, last_index_before, let, lines, strip
from .chunking import full_text

# Statuses, phrases, month names and descriptions that results are compared by.
STANDARD, NONSTANDARD, UNKNOWN = "СТАНДАРТНЫЙ", "НЕ СТАНДАРТНЫЙ", "НЕ МОГУ ОПРЕДЕЛИТЬ"
E_NO_TEXT = "Не удалось получить текст документа"
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
FORM_PHRASES = ["по форме контрагента", "форме поставщика", "форме подрядчика", "форме исполнителя", "не по форме, утверждённой"]
UNLIMITED = ["бессроч", "автоматическ", "пролонгац", "полного выполн"]
SPELLED = ["двадцати", "тридцати", "сорока", "пятидесяти"]
SPELLED_DAYS = [("сорока пяти", "45 дней"), ("сорока", "40 дней"), ("тридцати пяти", "35 дней"), ("тридцати", "30 дней"), ("пятидесяти", "50 дней"), ("двадцати", "20 дней")]
APPROVALS = ["банковская гарантия", "банковской гарантии", "аккредитация", "одобрен", "полномочи"]
CHANGES = ["изменение условий", "дополнительные условия", "особые условия", "отличающиеся от стандартных", "в отступление от"]
ALLOWED_CHANGES = ["срок оплат", "срок приемки", "ответственность заказчика", "гарантийн", "гарантий"]
SPECIFICATION = ["спецификация", "приложение", "техническое задание", "тз"]
SPECIFICATION_PARTS = ["предмет", "цена", "срок", "стоимость"]
FRAMEWORK = ["рамочный договор", "генеральное соглашение", "договор на неопределенный объем"]
D_FORM = "Договор составлен по форме контрагента, а не по утвержденной стандартной форме"
D_UNLIMITED = "Срок действия договора не ограничен 3 годами (бессрочный или с автоматической пролонгацией)"
D_OVER = "Срок действия договора превышает 3 года ("
D_NO_END = "Срок действия договора не указан явно (нет конкретной конечной даты)"
D_NO_TERM = "Срок действия договора не указан"
D_PAYMENT = "Срок оплаты установлен менее 60 календарных дней ("
D_NO_PAYMENT = "Условие о сроке оплаты не найдено"
D_PREPAID_CHECK = "Предоплата требует проверки соблюдения всех условий п.6.6 (банковская гарантия, аккредитация, одобрения и др.)"
D_PREPAID = "Предусмотрена предоплата без соблюдения требований п.6.6 (отсутствуют банковская гарантия, аккредитация, одобрения)"
D_ACCEPT = "Срок приемки результатов работ/услуг менее 5 рабочих дней ("
D_NO_ACCEPT = "Срок приемки работ/услуг не указан (требуется ≥ 5 рабочих дней)"
D_PAY_DAY = "Условие об одном платежном дне в неделю изменено"
D_NO_PAY_DAY = "В тексте отсутствует условие об одном платежном дне в неделю"
D_PROTOCOL = "Обнаружено упоминание протокола разногласий (нестандартные изменения условий договора)"
D_CHANGES = "Обнаружены недопустимые изменения базовых условий договора"
D_SPECIFICATION, F_SPECIFICATION = "В спецификации/приложении отсутствуют обязательные элементы: ", "Спецификация неполная"
D_FRAMEWORK, F_FRAMEWORK = "В рамочном договоре не указаны лимиты или максимальные объемы", "Отсутствуют лимиты рамочного договора"
#: Categories by the first phrase that a lower-cased description holds; the rest are OTHER.
CATEGORIES = [
    ("Срок действия", ["срок действия"]),
    ("Условия оплаты", ["срок оплаты"]),
    ("Предоплата", ["предоплат", "аванс"]),
    ("Приемка работ", ["приемки"]),
    ("Платежные дни", ["платежный день"]),
    ("Протокол разногласий", ["протокол разноглас"]),
]
OTHER = "Прочие"
SHORTEST, TERM_DAYS = 50, 3 * 365

P_DURATION = r"(?:^|[^0-9])(\d{1,2})\s*(?:год[а-я]*|лет|месяц[а-я]*)"
P_END = r"(?:до|по)\s+(\d{1,2})\s+([а-я]+)\s+(20\d\d)"
P_PAYMENT = r"(?iuU)(?:течение|срок|в)\s+(\d+)\s+(календарн\w*|рабочих?)\s+дн\w*"
P_ACCEPT = r"(?iuU)(?:прием|акт)[^.\n]*?(\d+)\s*рабочих?\s*дн"


def _finding(rule: str, description: Column | str, found: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array(F.struct(F.lit(rule).alias("rule_id"), as_column(description).alias("description"), as_column(found).alias("found_text")))


def _none() -> Column:
    return F.array().cast("array<struct<rule_id:string,description:string,found_text:string>>")


def _number(digits: Column) -> Column:
    return digits.try_cast("bigint")


def _sentence(text: Column, low: Column, phrase: str, reach: int) -> Column:
    """From the full stop before the first phrase to the one after it, or reach characters on."""

    def cut(at: Column) -> Column:
        stop = index_of(text, ".", at)
        end = F.when(stop < 0, F.least(at + reach, F.length(text))).otherwise(stop)
        return between(text, F.greatest(last_index_before(text, ".", at) + 1, F.lit(0)), end)

    return let(index_of(low, phrase), cut)


def _pieces(text: Column) -> Column:
    """What stands between full stops and line feeds."""
    return F.split(text, r"[.\n]")


def form_rule(text: Column, low: Column) -> Column:
    out = _none()
    for phrase in reversed(FORM_PHRASES):
        out = F.when(low.contains(phrase), _finding("L1", D_FORM, strip(_sentence(text, low, phrase, 100)))).otherwise(out)
    return out


def term_clause(text: Column, low: Column) -> Column:
    """The clause on the contract's term, or null."""
    start = F.when(low.contains("срок действия"), index_of(low, "срок действия")).when(low.contains("договор действует"), index_of(low, "договор действует"))
    return strip(F.element_at(_pieces(F.substring(text, start + 1, F.length(text))), 1))


def term_rule(text: Column, low: Column, as_of: datetime.date) -> Column:
    def judge(clause: Column) -> Column:
        lowered = F.lower(clause)
        amount = _number(F.regexp_extract(lowered, P_DURATION, 1))
        months = F.regexp_extract(lowered, P_DURATION, 0).contains("месяц")
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(lowered, P_END, 2)).cast("int")
        day, year = (F.regexp_extract(lowered, P_END, k).try_cast("int") for k in (1, 3))
        # 0 stands for no match; both give no date
        end = F.call_function("try_make_timestamp", year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        days = F.date_diff(end, F.lit(as_of))
        too_long = F.concat(F.lit(D_OVER), F.format_string("%.1f", days / 365.0), F.lit(" года до "), F.date_format(end, "dd.MM.yyyy"), F.lit(")"))
        return (
            F.when(clause.isNull(), _finding("L2f", D_NO_TERM, ""))
            .when(any_of(lowered, UNLIMITED), _finding("L2b", D_UNLIMITED, clause))
            .when(amount.isNotNull() & months, F.when(amount > 36, _finding("L2c", F.concat(F.lit(D_OVER), amount.cast("string"), F.lit(" мес.)")), clause)).otherwise(_none()))
            .when(amount.isNotNull(), F.when(amount > 3, _finding("L2c", F.concat(F.lit(D_OVER), amount.cast("string"), F.lit(" года)")), clause)).otherwise(_none()))
            .when(end.isNull(), _finding("L2e", D_NO_END, clause))
            .when(days > TERM_DAYS, _finding("L2d", too_long, clause))
            .otherwise(_none())
        )

    return let(term_clause(text, low), judge)


def payment_rule(text: Column, low: Column) -> Column:
    return let(F.regexp_extract(text, P_PAYMENT, 0), lambda found: _payment(text, low, found))


def _payment(text: Column, low: Column, found: Column) -> Column:
    days = _number(F.regexp_extract(found, r"(?U)\d+", 0))
    start = F.regexp_instr(text, F.lit(P_PAYMENT)) - 1
    around = between(low, F.greatest(start - 50, F.lit(0)), F.least(start + F.length(found) + 50, F.length(text)))
    short = lambda unit: _finding("L3a", F.concat(F.lit(D_PAYMENT), days.cast("string"), F.lit(unit)), found)
    numeric = F.when(F.lower(found).contains("рабочих"), F.when(days < 43, short(" рабочих дн.)")).otherwise(_none())).otherwise(
        F.when((days < 60) & ~any_of(around, ["закона", " фз"]), short(" дн.)")).otherwise(_none())
    )

    def named(line: Column) -> Column:
        lowered, label = F.lower(line), F.lit(None).cast("string")
        for phrase, days_text in reversed(SPELLED_DAYS):
            label = F.when(lowered.contains(phrase), F.lit(days_text)).otherwise(label)
        return F.element_at(_finding("L3b", F.concat(F.lit(D_PAYMENT), label, F.lit(")")), strip(line)), 1)

    spelled_out = "(?iu)" + "|".join(["шестидесяти", *SPELLED])
    on_terms = F.filter(lines(text), lambda x: x.rlike("(?iu)оплат|платеж|расчет") & x.rlike("(?iu)дней|дня") & ~x.rlike(r"(?U)\d") & x.rlike(spelled_out))
    spelled = let(on_terms, lambda xs: F.when(F.size(xs) == 0, _finding("L3c", D_NO_PAYMENT, "")).otherwise(F.transform(F.filter(xs, lambda x: ~F.lower(x).contains("шестидесяти")), named)))
    unstated = _finding("L3c", D_NO_PAYMENT, "")
    return F.when(found != "", numeric).when(low.rlike("дней|дня") & low.rlike("оплат|платеж|расчет"), spelled).otherwise(unstated)


def prepayment_rule(text: Column, low: Column) -> Column:
    plain = F.filter(_pieces(text), lambda x: x.rlike("(?iu)предоплат|аванс") & ~x.rlike("(?iu)без предоплат|без аванс|не "))
    what = F.when(any_of(low, APPROVALS), F.lit(D_PREPAID_CHECK)).otherwise(F.lit(D_PREPAID))
    found = let(plain, lambda xs: F.when(F.size(xs) > 0, _finding("L4", what, strip(F.get(xs, 0)))).otherwise(_none()))
    return F.when(any_of(low, ["предоплат", "аванс"]), found).otherwise(_none())


def acceptance_rule(text: Column, low: Column) -> Column:
    def judge(found: Column) -> Column:
        days = _number(F.regexp_extract(found, P_ACCEPT, 1))
        short = _finding("L5", F.concat(F.lit(D_ACCEPT), days.cast("string"), F.lit(" дн.)")), found)
        return F.when(found == "", _finding("L5", D_NO_ACCEPT, "")).when(days < 5, short).otherwise(_none())

    return F.when(any_of(low, ["услуг", "работ"]), let(F.regexp_extract(text, P_ACCEPT, 0), judge)).otherwise(_none())


def pay_day_rule(text: Column, low: Column) -> Column:
    weekly = F.filter(lines(text), lambda x: x.rlike("(?iu)платеж") & x.rlike("(?iu)недел"))
    fine = lambda x: x.rlike("(?iu)1 раз в неделю|один раз в неделю|один платежный день")
    missing = _finding("L6", D_NO_PAY_DAY, "")
    judged = let(F.get(weekly, 0), lambda x: F.when(x.isNull(), missing).when(fine(x), _none()).otherwise(_finding("L6", D_PAY_DAY, strip(x))))
    return F.when(low.contains("платеж") & low.contains("недел"), judged).otherwise(missing)


def protocol_rule(text: Column, low: Column) -> Column:
    holding = F.filter(_pieces(text), lambda x: F.lower(x).contains("протокол разноглас"))
    return F.when(low.contains("протокол разноглас"), _finding("L7", D_PROTOCOL, strip(F.get(holding, 0)))).otherwise(_none())


def changes_rule(text: Column, low: Column) -> Column:
    out = _none()
    for phrase in reversed(CHANGES):
        judged = _sentence(text, low, phrase, 150)
        out = F.when(low.contains(phrase) & ~any_of(F.lower(judged), ALLOWED_CHANGES), _finding("L8", D_CHANGES, strip(judged))).otherwise(out)
    return out


def specification_rule(text: Column, low: Column) -> Column:
    missing = F.filter(F.array(*map(F.lit, SPECIFICATION_PARTS)), lambda p: ~low.contains(p))
    listed = F.concat(F.lit(D_SPECIFICATION), F.array_join(missing, ", "))
    return F.when(any_of(low, SPECIFICATION) & (F.size(missing) > 2), _finding("L10", listed, F_SPECIFICATION)).otherwise(_none())


def framework_rule(text: Column, low: Column) -> Column:
    return F.when(any_of(low, FRAMEWORK) & ~any_of(low, ["лимит", "объем"]), _finding("L11", D_FRAMEWORK, F_FRAMEWORK)).otherwise(_none())


def audit(contracts: DataFrame, as_of: datetime.date, text: str = "text") -> DataFrame:
    """contracts with status and violations (in the order of the rules).

    Null, blank and short texts (under 50 characters) cannot be judged. as_of is the day that end
    dates are compared with.
    """
    t, low = F.col(text), F.col("__low")
    rules = [form_rule, lambda a, b: term_rule(a, b, as_of), payment_rule, prepayment_rule, acceptance_rule, pay_day_rule, protocol_rule, changes_rule, specification_rule, framework_rule]
    known = t.isNotNull() & t.rlike(r"(?U)\S") & (F.length(t) >= SHORTEST)
    out = contracts.withColumn("__low", F.lower(t)).withColumn("violations", F.when(known, F.concat(*[r(t, low) for r in rules])).otherwise(_none()))
    status = F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(F.size("violations") > 0, NONSTANDARD).otherwise(STANDARD)
    return out.withColumn("status", status).drop("__low")


def audit_stored(docs: DataFrame, chunks: DataFrame, as_of: datetime.date, key: str = "doc_id") -> DataFrame:
    """The audit of texts as they are stored: key, status, violations, error.

    A document's chunks are joined by blanks in their order, overlaps included. Documents without chunks cannot be
    judged and say so in error, which is null for all others.
    """
    rebuilt = docs.select(key).join(full_text(chunks, key), key, "left")
    error = F.when(F.col("text").isNull(), F.lit(E_NO_TEXT))
    return audit(rebuilt, as_of).select(key, "status", "violations", error.alias("error"))


def violations(audited: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per violation, numbered from 1 in each document."""
    # the outer form: for the inner one Spark adds a filter that computes all violations once more
    rows = audited.select(key, F.posexplode_outer("violations").alias("pos", "v")).filter("pos IS NOT NULL")
    return rows.select(key, (F.col("pos") + 1).alias("ord"), "v.*")


def category(description: Column) -> Column:
    out = F.lit(OTHER)
    for name, phrases in reversed(CATEGORIES):
        out = F.when(any_of(F.lower(description), phrases), F.lit(name)).otherwise(out)
    return out


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(category(F.col("description")).alias("category")).agg(F.count("*").alias("n"))
