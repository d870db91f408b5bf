"""Column expressions: wells, doses, labels and text scores. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unify_well(well: Column) -> Column:
    """A01 -> A1; other spellings unchanged."""
    return F.regexp_replace(well, r"^([A-Z])0*(\d+)$", "$1$2")


def well_row(well: Column) -> Column:
    return F.ascii(F.substring(well, 1, 1)) - 64


def well_col(well: Column) -> Column:
    return F.regexp_extract(well, r"(\d+)$", 1).try_cast("int")


def well_name(row: Column, col: Column) -> Column:
    return F.concat(F.char(row + 64), col.cast("string"))


def feature_name(molecule: Column, adduct: Column) -> Column:
    return F.concat(molecule, F.lit(" ["), adduct, F.lit("]"))


def molecule_of(feature: Column) -> Column:
    return F.split_part(feature, F.lit(" ["), F.lit(1))


def well_of_replicate(replicate: Column) -> Column:
    """Third piece between dashes, up to the first underscore or dot."""
    piece = F.split_part(replicate, F.lit("-"), F.lit(3))
    return F.split_part(F.split_part(piece, F.lit("_"), F.lit(1)), F.lit("."), F.lit(1))


def sample_type(label: Column) -> Column:
    return F.when(label == "MAT1", "Blank").when(label == "MAT2", "QC").otherwise(label)


def first_number(text: Column) -> Column:
    """The first number in a text, else 0."""
    return F.coalesce(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def dose_value(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")


def dose_unit(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*\d+(?:\.\d+)?\s*(%|[^\s\d]\S*)", 1), F.lit(""))


def concentration(text: Column) -> Column:
    """struct<value, unit, kind>: percentages say w/v or v/v (w/v if unsaid); degrees and words for nothing are 0 mM."""
    low = F.lower(F.trim(text))
    nothing = low.isNull() | low.isin("", "none", "null", "nan", "n/a") | F.contains(text, F.lit("°"))
    plain = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    percent = F.contains(plain, F.lit("%"))
    kind = F.when(nothing | ~percent, "molar").when(F.contains(low, F.lit("v/v")), "v/v").otherwise("w/v")
    return F.struct(F.when(nothing, 0.0).otherwise(first_number(plain)).alias("value"),
                    F.when(nothing, "mM").when(percent, "%").otherwise(dose_unit(plain)).alias("unit"), kind.alias("kind"))


def to_millimolar(value: Column, unit: Column, weight: Column) -> Column:
    """Molar units directly, mass per volume through the molecular weight (g/mol)."""
    factor = F.when(unit == "M", 1e3).when(unit == "mM", 1.0).when(unit.isin("uM", "µM"), 1e-3).when(unit == "nM", 1e-6)
    mass = F.when(unit == "g/L", 1e3).when(unit == "mg/mL", 1e3).when(unit == "mg/L", 1.0).when(unit == "ug/mL", 1.0)
    return F.coalesce(value * factor, value * mass / weight)


def percent_volume(percent: Column, total: Column, stock_percent: Column) -> Column:
    """Null for a stock of nothing."""
    return F.when(percent == 0, 0.0).otherwise(percent * total / F.nullif(stock_percent, F.lit(0)))


def dilution_volume(stock: Column, final: Column, total: Column) -> Column:
    """C1 V1 = C2 V2; nothing wanted, nothing taken; null for a stock of nothing."""
    return F.when(final == 0, 0.0).otherwise(final * total / F.nullif(stock, F.lit(0)))


def volume_balance(total: Column, preculture: Column, additions: list[Column]) -> Column:
    """struct<water, ok>: what fills the well; ok if no part is negative and water remains."""
    taken, whole = preculture, preculture >= 0
    for a in additions:
        taken, whole = taken + a, whole & (a >= 0)
    return F.struct((total - taken).alias("water"), ((total - taken > 0) & whole).alias("ok"))


def direction(coef: Column) -> Column:
    return F.when(coef > 0, "higher").when(coef < 0, "lower")


def changed(direction: Column) -> Column:
    """The word of the ontology's relation; other words stay."""
    return F.when(direction == "lower", "decreased").when(direction == "higher", "increased").otherwise(direction)


def is_treated(answer: Column) -> Column:
    return F.coalesce(F.lower(answer) == "yes", F.lit(False))


def chosen_option(text: Column) -> Column:
    """The number that a free text names as its choice; null if it names none."""
    return F.regexp_extract(text, r"HYPOTHESIS NUMBER #(\d+)", 1).try_cast("int")


def clean_name(name: Column, spellings: dict[str, str] | None = None) -> Column:
    """Commas become underscores, then spellings are replaced."""
    out = F.replace(name, F.lit(","), F.lit("_"))
    for old, new in (spellings or {"Aluminium": "Aluminum"}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def mentions(text: Column, word: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Whether the lower-cased text holds the word, once synonyms in the word are replaced."""
    for old, new in (synonyms or {"glutamate": "glutamic acid"}).items():
        word = F.replace(word, F.lit(old), F.lit(new))
    return F.contains(F.lower(text), F.lower(word))


def any_column_contains(columns: list[Column], key: Column) -> Column:
    """Whether any column holds the key, whatever the case; nulls hold nothing."""
    return F.exists(F.array(*(c.cast("string") for c in columns)), lambda x: F.coalesce(F.contains(F.lower(x), F.lower(key)), F.lit(False)))


def log_response(x: Column, eps: float = 1e-2) -> Column:
    return F.log(x + eps)


def percent_change(beta: Column, term: Column) -> Column:
    return F.when(term != "Intercept", (F.exp(beta) - 1) * 100)


def condition_key(supplement: Column, dose: Column, treatment: Column, treat_dose: Column) -> Column:
    return F.concat(supplement, F.lit(": "), F.coalesce(dose, F.lit("0 mM")), F.lit(" & "), treatment, F.lit(": "), F.coalesce(treat_dose, F.lit("0 mM")))


def folder_time(folder: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(folder, r"(\d{12})", 1), F.lit("yyyyMMddHHmm"))


def iri(base: str, value: Column) -> Column:
    return F.concat(F.lit(base), value.cast("string"))


def occurrences(text: Column, word: Column) -> Column:
    """How often a literal stands in the lower-cased text, without overlap."""
    return F.when(word == "", 0).otherwise((F.length(text) - F.length(F.replace(F.lower(text), word, F.lit("")))) / F.length(word))


def specificity(target: Column, others: Column, alpha: float) -> Column:
    """ln(1 + |t|) / ln(1 + |t| + others ** alpha), with 0 ** 0 = 1."""
    rest = F.lit(1.0) if alpha == 0 else F.pow(others, F.lit(alpha))
    return F.log1p(F.abs(target)) / F.log1p(F.abs(target) + rest)


def any_contained(text: Column, items: Column) -> Column:
    return F.exists(items, lambda x: F.contains(F.lower(text), F.lower(x)))


def statements(text: Column) -> Column:
    """Numbered statements, one a line."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s*(.+?)\s*$"), F.lit(1))


def json_body(text: Column) -> Column:
    """Text without code fences, or null if it is no JSON."""
    body = F.regexp_replace(text, r"^\s*(?:```(?:json)?\s*)?|\s*(?:```\s*)?$", "")
    return F.when(F.try_parse_json(body).isNotNull(), body)


def inner_predicates(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"([a-z_]\w*\([^()]*\))"), F.lit(1))


def euclid(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.sqrt(F.pow(r1 - r2, 2) + F.pow(c1 - c2, 2))
