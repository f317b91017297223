"""String functions with the white space, number and masking rules of the source documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Fixed value: white space as script languages have it, which is wider than Spark's and Java's.
SPACE = r"\s   -     　﻿"


#: The same characters, each by itself.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def normal_email(c: Column) -> Column:
    return F.lower(trim(c))


def clean_cell(c: Column) -> Column:
    """White space, line breaks included, as single blanks, none at the ends; null as empty."""
    return trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{SPACE}]+", " "))


def shorten(c: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def parse_numeric(value: Column, category: Column | None = None) -> Column:
    """The number a value begins with, or its fraction; null for dates, zero denominators and no number."""
    t = trim(value)
    top, bottom = (F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)", k).try_cast("double") for k in (1, 2))
    lead = F.regexp_extract(t, r"^[-+]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    out = F.when(t.rlike(r"^\d{4}년\s*\d{1,2}월"), F.lit(None)).when(t.rlike(r"^\d+\s*/\s*\d+"), F.try_divide(top, bottom)).otherwise(lead)
    return out if category is None else F.when(F.coalesce(category == "date", F.lit(False)), F.lit(None)).otherwise(out)


#: Pattern and unit, in the order they are tried; longer units stand before their endings.
UNITS = [("%", "%"), ("배수", "배수"), ("배$", "배"), ("만원", "만원"), ("원$", "원"), ("kg", "kg"), ("톤", "톤"), ("ha", "ha"), ("㎡", "㎡"),
         ("개월", "개월"), ("주", "주"), ("일$", "일"), ("년$", "년"), ("회$", "회"), ("시간", "시간"), ("개$", "개"), ("본$", "본"), ("그루", "그루")]


def extract_unit(value: Column) -> Column:
    t = trim(value)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(u)) for p, u in UNITS])


#: Keys whose values are personal or secret, and keys that hold whole requests.
MASKED_KEYS = """password pwd token secret apikey api_key authorization authheader authtoken bearertoken jwt refreshtoken
accesstoken sessionid csrftoken privatekey encryptionkey clientsecret cookie cardnumber pan cvc cvv cardholdername
businessregistrationnumber bizregnumber ssn rrn residentnumber personalid passport driverlicense nationalid""".split()
DUMP_KEYS = "rawpayload payload body headers params raw formdata queryparams searchparams".split()
#: A signed token inside a text, and home folders of three systems.
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
HOMES = (r"/home/[^/\s]+/", r"/Users/[^/\s]+/", r"[A-Z]:\\Users\\[^\\]+\\")


def mask(key: Column, value: Column) -> Column:
    """A log value without secrets: masked by its key, an e-mail shortened, tokens inside it replaced."""
    k = F.lower(key)
    email = F.when(F.instr(value, "@") > 0, F.regexp_replace(value, r"^([^@]{1,2})[^@]*(@.*)$", "$1***$2")).otherwise("[MASKED:email?]")
    return (
        F.when(k.isin(*MASKED_KEYS), "[MASKED]")
        .when(k.isin(*DUMP_KEYS), "[REDACTED:raw_dump]")
        .when(k == "email", email)
        .otherwise(F.regexp_replace(value, JWT, "[MASKED:jwt]"))
    )


#: Fixed value: how deep nested values are masked.
MASK_DEPTH = 6


def mask_nested(name: str, value: Column, kind: DataType, depth: int = 0) -> Column:
    """A log value of any type without secrets: structs and arrays are masked part by part, as their schema has them.

    Masked and redacted values become strings; what lies deeper than MASK_DEPTH is cut. Elements of an array bear no key of their own.
    """
    k = name.lower()
    if k in MASKED_KEYS or k in DUMP_KEYS:
        return F.when(value.isNotNull(), F.lit("[MASKED]" if k in MASKED_KEYS else "[REDACTED:raw_dump]"))
    if isinstance(kind, StringType):
        return mask(F.lit(k), value)
    if isinstance(kind, (StructType, ArrayType, MapType)) and depth >= MASK_DEPTH:
        return F.when(value.isNotNull(), F.lit("[TRUNCATED:depth]"))
    if isinstance(kind, StructType):
        fields = [mask_nested(f.name, value[f.name], f.dataType, depth + 1).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: mask_nested(f"{k}[]", x, kind.elementType, depth + 1))
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        return mask_map(value)
    return value


def mask_map(context: Column) -> Column:
    return F.transform_values(context, lambda k, v: mask(k, v))


def redact_homes(c: Column) -> Column:
    for pattern in HOMES:
        c = F.regexp_replace(c, pattern, "[REDACTED_HOME]/")
    return c


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """``{{k}}`` replaced by the value of k; names without a value stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("{{" + k + "}}")))
    return template


def lookup_path(tree: Column, path: str) -> Column:
    """The string at a dotted path of a VARIANT, or the path itself."""
    return F.coalesce(F.try_variant_get(tree, "$." + path, "string"), F.lit(path))


def relative_days(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "tomorrow").when(days == -1, "yesterday").when(days > 0, F.concat(F.lit("in "), days.cast("string"), F.lit(" days"))).otherwise(F.concat((-days).cast("string"), F.lit(" days ago")))


def breach_count(body: Column, suffix: Column) -> Column:
    """The count beside ``suffix`` in lines of SUFFIX:COUNT; 0 if not listed or not positive, null for a blank body."""
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x))
    hit = F.get(F.filter(lines, lambda x: F.upper(F.substring_index(x, ":", 1)) == F.upper(suffix)), 0)
    count = F.coalesce(F.substring_index(hit, ":", -1).try_cast("int"), F.lit(0))
    return F.when(F.coalesce(trim(body), F.lit("")) == "", F.lit(None)).otherwise(F.greatest(count, F.lit(0)))


def grouped(c: Column, decimals: int = 0) -> Column:
    """A number with thousands separated by commas."""
    return F.format_number(c, decimals)


def won(c: Column) -> Column:
    """An amount of money, without decimals."""
    return F.concat(F.lit("\u20a9"), F.format_number(c, 0))


def one_decimal_percent(share: Column) -> Column:
    return F.concat(F.format_string("%.1f", (share * 100).cast("double")), F.lit("%"))


#: What a user reads when a service is degraded; %s is the page, or the unit.
DEGRADED = {
    "low_similarity": "이 주제는 교재 %s가 더 정확합니다. AI 해설 대신 교재 원문을 권장합니다.",
    "d1_5xx_with_kv": "현재 일시적으로 최신 데이터 로드에 문제가 있어 최근 응답을 보여드립니다. 최신 정보는 교재 %s를 확인하세요.",
    "d1_5xx_no_kv": "일시적인 접속 문제로 이 정보를 불러올 수 없습니다. 잠시 후 다시 시도해주시거나 교재 %s를 참고하세요.",
    "write_path_503": "저장 중 문제가 발생했습니다. 잠시 후 자동 재시도합니다.",
    "claude_rate_limit": "잠시 후 다시 시도해주세요. 즉시 학습을 계속하려면 교재 %s를 참고하세요.",
}


def degradation(reason: Column, page: Column) -> Column:
    """The text for a reason, with the page if it is known; null for an unknown reason."""
    place = F.coalesce(F.concat(page.cast("string"), F.lit(" 페이지")), F.lit("해당 단원"))
    out = F.lit(None).cast("string")
    for name, template in DEGRADED.items():
        out = F.when(reason == name, F.replace(F.lit(template), F.lit("%s"), place)).otherwise(out)
    return out


def text_list(c: Column) -> Column:
    """The strings of a JSON array in a text column; empty where it is null or malformed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
