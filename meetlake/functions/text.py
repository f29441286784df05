"""Text clean-up, names and label rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Unicode white space plus the ASCII separators that count as space in result sheets
BLANK_CHARS = ("\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
               + "".join(map(chr, range(0x2000, 0x200B))))
SPACES = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def squash(c: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def squash_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, r'{SPACES}', ' '))"


def strip(c: Column) -> Column:
    """Trim white space at both ends, inner runs stay."""
    return F.trim(c, F.lit(BLANK_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normal_name(c: Column) -> Column:
    return F.upper(squash(c))


def identity_text(c: Column) -> Column:
    """Squashed upper case, empty becomes null."""
    return blank_to_null(normal_name(c))


def optional_text(c: Column) -> Column:
    """Trimmed upper case without touching inner spaces, empty becomes null."""
    return blank_to_null(F.upper(strip(c)))


def lines_sql(text: str) -> str:
    """Trimmed, non-empty lines of a whole text."""
    blanks = "".join(f"\\u{ord(ch):04x}" for ch in BLANK_CHARS)
    return f"filter(transform(split({text}, r'{LINE_BREAKS}'), l -> trim(BOTH '{blanks}' FROM l)), l -> l <> '')"


def raw_lines(text: Column) -> Column:
    """Lines as they are; a final line break opens no extra line, an empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAKS})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAKS))


def has(text: Column, pattern: str) -> Column:
    """Pattern search where word borders, digits and blanks follow Unicode on every JDK."""
    return text.rlike("(?U)" + pattern)


def any_in(text: Column, terms) -> Column:
    """True when the text contains one of the terms."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def group(c: Column, pattern: str, index: int) -> Column:
    """Capture group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, index))


def athlete_id(name: Column) -> Column:
    """Stable id from the normalised name."""
    return F.concat(F.lit("ATH-"), F.substring(F.sha2(normal_name(name), 256), 1, 16))


def resolved_athlete_id(name: Column, birth: Column) -> Column:
    """Id from name and birth date; from the name alone when the date is unknown. A missing name fails the job."""
    who, born = F.coalesce(identity_text(name), F.raise_error(F.lit("an athlete name is required")).cast("string")), identity_text(birth)
    key = F.when(born.isNull(), who).otherwise(F.concat(who, F.lit("|"), born))
    return F.concat(F.lit("ATH-"), F.substring(F.sha2(key, 256), 1, 16))


def resolved_confidence(birth: Column) -> Column:
    return F.when(identity_text(birth).isNull(), F.lit("CANDIDATE")).otherwise(F.lit("HIGH"))


def year_of(c: Column) -> Column:
    """First free-standing year 19xx or 20xx in a text."""
    return group(c.cast("string"), r"(?U)\b((?:19|20)\d{2})\b", 1).cast("int")


def equipment_of(competition: Column) -> Column:
    """Equipment from the competition name; the equipped label wins over the classic one."""
    name = F.lower(competition)
    return (F.when(name.contains("equipped"), F.lit("EQUIPPED"))
            .when(name.contains("classic"), F.lit("CLASSIC"))
            .otherwise(F.lit("UNKNOWN")))


# fixed values: other spellings of equipment and division labels
EQUIPMENT_ALIASES = {"RAW": "CLASSIC", "RAW CLASSIC": "CLASSIC"}
DIVISION_ALIASES = {
    "SUBJUNIOR": "Sub Junior", "SUB JUNIOR": "Sub Junior", "SUB-JUNIOR": "Sub Junior",
    "JUNIOR": "Junior", "OPEN": "Open",
    "MASTER 1": "Master 1", "MASTER 2": "Master 2", "MASTER 3": "Master 3", "MASTER 4": "Master 4",
}


def _alias(key: Column, table: dict[str, str], other: Column) -> Column:
    for old, new in table.items():
        other = F.when(key == old, F.lit(new)).otherwise(other)
    return other


def canonical_equipment(c: Column) -> Column:
    key = F.upper(strip(c))
    return _alias(key, EQUIPMENT_ALIASES, key)


def canonical_division(c: Column) -> Column:
    text = strip(c)
    return _alias(F.upper(text), DIVISION_ALIASES, text)


# fixed values: weight classes (upper bound in kg) and meet tiers
CLASS_LIMITS = (53, 59, 66, 74, 83, 93, 105, 120)
OPEN_CLASS = "120+"
TIERS = ("State", "National", "International")


def weight_class_of(bodyweight: Column) -> Column:
    """Class label for a bodyweight: the first limit not exceeded, else the open class."""
    return F.coalesce(*[F.when(bodyweight <= k, F.lit(str(k))) for k in CLASS_LIMITS],
                      F.when(bodyweight.isNotNull(), F.lit(OPEN_CLASS)))


def class_index(bodyweight: Column) -> Column:
    """Position of the class in the ascending list, 0 for the lightest."""
    return F.when(bodyweight.isNotNull(), sum((bodyweight > k).cast("int") for k in CLASS_LIMITS))


def category_class(category: Column) -> Column:
    """Numeric class of a label such as 'Men 83 kg'; the open class folds into 120; null if unknown."""
    pattern = r"(?i)^Men\s+(\d+)(\+?)\s*kg$"
    text = strip(category)
    number = group(text, pattern, 1).cast("int")
    plus = group(text, pattern, 2) == "+"
    return F.when(plus, F.when(number == 120, number)).when(number.isin(*CLASS_LIMITS), number)


def class_label(category: Column) -> Column:
    """The '83 kg' part of a category text."""
    return group(category, r"(\d+(?:\.\d+)?\+?\s*kg)", 1)


def checked_category(category: Column) -> Column:
    """category_class that fails the job on an unknown category."""
    return F.coalesce(category_class(category),
                      F.raise_error(F.concat(F.lit("unsupported category: "), category)).cast("int"))


def checked_tier(tier: Column) -> Column:
    return F.when(strip(tier).isin(*TIERS), strip(tier)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported meet tier: "), tier)))
