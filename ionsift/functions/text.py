"""Strings: categories, instruments, keys, SMILES tokens, slugs, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The token pattern of SMILES, and names of instruments of high resolution.
SMILES_TOKEN = r"\[[^\]]+\]|Br|Cl|Si|Na|Li|Ca|Mg|Al|Se|se|@@|%\d\d|."
HIGH_RESOLUTION = ("qtof", "orbitrap", "qexactive", "ft", "timstof", "toftime")
SPECIAL = ["<pad>", "<bos>", "<eos>", "<unk>"]


def category(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("<missing>"))


def high_resolution(instrument: Column) -> Column:
    name = F.regexp_replace(F.lower(F.coalesce(instrument, F.lit(""))), "[- ]", "")
    return name.rlike("|".join(HIGH_RESOLUTION))


def identity_key(inchikey: Column) -> Column:
    """The two-dimensional part of an InChIKey."""
    return F.substring(inchikey, 1, 14)


def joined(values: Column, separator: str = ";") -> Column:
    return F.array_join(values, separator)


def parts(value: Column, separator: str = ";") -> Column:
    """The trimmed, non-empty parts of a list in a string."""
    return F.filter(F.transform(F.split(value, separator), lambda x: F.trim(x)), lambda x: x != "")


def slug(value: Column) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def smiles_tokens(smiles: Column) -> Column:
    return F.regexp_extract_all(smiles, F.lit(f"({SMILES_TOKEN})"), F.lit(1))


def token_kind(token: Column) -> Column:
    """'bracket', 'atom', 'ring', 'bond', 'branch' or 'other'."""
    return (
        F.when(token.startswith("["), "bracket").when(token.rlike("^(Br|Cl|Si|Na|Li|Ca|Mg|Al|Se|se|[BCNOFPSIbcnops])$"), "atom").when(token.rlike(r"^(%\d\d|\d)$"), "ring")
        .when(token.isin("-", "=", "#", ":", "/", "\\", "~"), "bond").when(token.isin("(", ")"), "branch").otherwise("other")
    )


#: Tokens of a vocabulary that is broadcast at most; a larger one is joined.
VOCABULARY = 20_000


def vocabulary(df: DataFrame, smiles: str) -> DataFrame:
    """(token, id): four special tokens, then all tokens in order.  One row per distinct token."""
    found = df.select(F.explode(smiles_tokens(F.col(smiles))).alias("token")).distinct().where(~F.col("token").isin(SPECIAL))
    ids = found.select("token", (F.row_number().over(Window.orderBy("token")) + len(SPECIAL) - 1).cast("int").alias("id"))
    fixed = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIAL)], "token string, id int")
    return fixed.union(ids)


def encode(df: DataFrame, smiles: str, vocabulary: DataFrame, limit: int = 256) -> DataFrame:
    """The table with ``ids``: begin, tokens, end; null if a token is unknown or there are too many."""
    if vocabulary.limit(VOCABULARY + 1).count() > VOCABULARY:
        return _encoded_by_join(df, smiles, vocabulary, limit)
    known = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("__ids"))
    tokens = smiles_tokens(F.col(smiles))
    ids = F.transform(tokens, lambda t: F.try_element_at(F.col("__ids"), t))
    fine = (F.size(tokens) + 2 <= limit) & ~F.exists(ids, lambda x: x.isNull())
    # one row of a token vocabulary, whose size is checked above
    return df.crossJoin(F.broadcast(known)).withColumn("ids", F.when(fine, F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))))).drop("__ids")


def _encoded_by_join(df: DataFrame, smiles: str, vocabulary: DataFrame, limit: int) -> DataFrame:
    """encode() for any vocabulary: each distinct string's tokens meet it by a join."""
    own = df.select(F.col(smiles).alias("__s")).where(F.col("__s").isNotNull()).distinct()
    tokens = smiles_tokens(F.col("__s"))
    rows = own.where(F.size(tokens) + 2 <= limit).select("__s", F.posexplode_outer(tokens).alias("__at", "token"))
    met = rows.join(vocabulary.select("token", "id"), "token", "left").groupBy("__s")
    found = met.agg(F.array_sort(F.collect_list(F.struct("__at", "id"))).alias("__l"), F.count_if(F.col("token").isNotNull() & F.col("id").isNull()).alias("__odd")).where("__odd = 0")
    ids = F.concat(F.array(F.lit(1)), F.transform(F.filter("__l", lambda p: p["id"].isNotNull()), lambda p: p["id"]), F.array(F.lit(2)))
    return df.join(found.select(F.col("__s"), ids.alias("ids")), df[smiles] == F.col("__s"), "left").drop("__s")


def decode(ids: Column, tokens: Column) -> Column:
    """The string of ids up to the end token; ``tokens`` is the vocabulary in the order of its ids."""
    end = F.array_position(ids, F.lit(2)).cast("int")
    body = F.when(end > 0, F.slice(ids, F.lit(1), end - 1)).otherwise(ids)
    return F.array_join(F.transform(F.filter(body, lambda i: i >= len(SPECIAL)), lambda i: F.element_at(tokens, i + 1)), "")


def energy_signature(values: Column) -> Column:
    """The distinct energies in order; null if there are none, or one is missing, negative or not finite."""
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    return F.when((F.size(values) > 0) & ~bad, F.array_sort(F.array_distinct(values)))


def numeric_metadata(precursor: Column, energies: Column) -> Column:
    """precursor or 0; mean, minimum and maximum of the finite energies or 0; whether either is missing."""
    kept = F.filter(energies, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = F.coalesce(F.size(kept), F.lit(0))
    known = precursor.isNotNull() & ~F.isnan(precursor) & (F.abs(precursor) < float("inf"))
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    return F.struct(
        F.when(known, precursor).otherwise(0.0).alias("precursor"), F.coalesce(mean, F.lit(0.0)).alias("energy_mean"), F.coalesce(F.array_min(kept), F.lit(0.0)).alias("energy_min"),
        F.coalesce(F.array_max(kept), F.lit(0.0)).alias("energy_max"), (~known).cast("double").alias("no_precursor"), (n == 0).cast("double").alias("no_energy"),
    )


def one_hot(value: Column, categories: list[str]) -> Column:
    """Zeros and a one at the category's place; the last place is for unknown ones."""
    at = F.array_position(F.array(*[F.lit(c) for c in categories]), category(value))
    place = F.when(at > 0, at - 1).otherwise(len(categories))
    return F.transform(F.sequence(F.lit(0), F.lit(len(categories))), lambda i: (i == place).cast("double"))


def one_hot_column(value: Column, categories: Column) -> Column:
    """one_hot() by a fitted vocabulary, an array column."""
    at = F.array_position(categories, category(value))
    place = F.when(at > 0, at - 1).otherwise(F.size(categories))
    return F.transform(F.sequence(F.lit(0), F.size(categories)), lambda i: (i == place).cast("double"))
