"""Names of places: codes for what feeds and riders write, and suggestions for what nobody knows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import name_key

#: Codes by the letters of a name: fixed values.
CODES = {
    "CSMT": "CSMT", "MASJID": "MSD", "MASJIDBUNDER": "MSD", "SANDHURST": "SNRD", "SANDHURSTROAD": "SNRD", "BYCULLA": "BY",
    "CHINCHPOKLI": "CHG", "CURREY": "CRD", "CURREYROAD": "CRD", "PAREL": "PR", "DADAR": "DR", "MATUNGA": "MTN", "SION": "SION",
    "KURLA": "CLA", "VIDYAVIHAR": "VVH", "GHATKOPAR": "GC", "VIKHROLI": "VK", "KANJUR": "KJRD", "KANJURMARG": "KJRD",
    "BHANDUP": "BND", "NAHUR": "NHU", "MULUND": "MLND", "THANE": "TNA", "KALVA": "KLVA", "KALWA": "KLVA", "MUMBRA": "MBQ",
    "DIVA": "DIVA", "KOPAR": "KOPR", "DOMBIVLI": "DI", "THAKURLI": "THK", "KALYAN": "KYN", "SHAHAD": "SHAD", "AMBIVLI": "ABY",
    "TITWALA": "TLA", "VASIND": "VSD", "ASANGAON": "ASO", "KASARA": "KSRA", "VITHALWADI": "VLDI", "ULHASNAGAR": "ULNR",
    "AMBARNATH": "ABH", "BADLAPUR": "BUD", "NERAL": "NRL", "BHIVPURI": "BVS", "BHIVPURIROAD": "BVS", "KARJAT": "KJT", "KHOPOLI": "KHPI",
}
#: What riders write for a code, letters and digits in lower case: fixed values.
ALIASES = {
    "cst": "CSMT", "vt": "CSMT", "cstm": "CSMT", "chhatrapatishivajimaharajterminus": "CSMT", "masjidbunder": "MSD", "sandhurst": "SNRD",
    "currey": "CRD", "sin": "SION", "kanjur": "KJRD", "kalwa": "KLVA", "diwa": "DIVA", "dombivali": "DI", "dombivili": "DI",
    "kalyanjn": "KYN", "ulhas": "ULNR", "ambarnath": "ABH", "bhivpuri": "BVS", "titvala": "TLA", "umbermalli": "OMB", "oombermali": "OMB",
}
#: First digits of the numbers of another railway's trains, whose places share names with ours: fixed values.
OTHER_RAILWAY = ("90", "91", "92", "93", "94")
#: Likeness a suggestion needs: of short texts, and of others: fixed values.
SHORT, LIKE_SHORT, LIKE = 3, 0.65, 0.6


def typed_key(text: Column) -> Column:
    """Letters and digits of a text in lower case: what riders' names are matched by."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def station_alias(name: Column, train_number: Column) -> Column:
    """The code of a feed's place name, else the name in upper case with single blanks; another railway's names stay names."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    known = F.when(~F.substring(train_number, 1, 2).isin(*OTHER_RAILWAY), F.element_at(codes, F.coalesce(name_key(name), F.lit(""))))
    return F.coalesce(known, F.upper(F.trim(F.regexp_replace(name, r"\s+", " "))))


def directory(places: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``key, code``: every key a rider may write for the stations of ``places(code, name, seq)``.

    An alias wins over a code, a code over a name; of two stations with one
    name the one further down the line wins. Aliases of unknown stations drop out.
    """
    stations = places.groupBy("code").agg(F.max_by("name", "seq").alias("name"), F.max("seq").alias("seq"))
    also = places.sparkSession.createDataFrame(list((ALIASES if aliases is None else aliases).items()), "key string, code string")
    named = stations.select(typed_key(F.col("code")).alias("key"), "code", F.lit(1).alias("order"), "seq").unionByName(stations.select(typed_key(F.col("name")).alias("key"), "code", F.lit(2).alias("order"), "seq"))
    extra = also.join(stations.select("code", "seq"), "code").select("key", "code", F.lit(0).alias("order"), "seq")
    return named.unionByName(extra).groupBy("key").agg(F.min_by("code", F.struct("order", -F.col("seq"), "code")).alias("code"))


def station_lookup(texts: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``texts`` with ``station_code``: what ``column`` names, case, blanks and punctuation apart; null if nothing."""
    found = known.select(F.col("key").alias("key_"), F.col("code").alias("station_code"))
    return texts.withColumn("key_", typed_key(F.col(column))).join(found, "key_", "left").drop("key_")


def bounded_directory(known: DataFrame, most: int = 50_000) -> dict[str, str]:
    """A directory as a dictionary for tasks; stations are few, and more than ``most`` keys are refused."""
    rows = known.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keys of stations")
    return {r["key"]: r["code"] for r in sorted(rows)}


def station_suggest(texts: DataFrame, column: str, known: DataFrame, n: int = 3) -> DataFrame:
    """Distinct texts of ``column`` with ``suggestions``: up to ``n`` codes whose keys look alike, best first."""
    codes = bounded_directory(known)

    @F.pandas_udf("array<string>")
    def suggest(keys: pd.Series) -> pd.Series:
        def one(key: str | None) -> list[str]:
            like = difflib.get_close_matches(key, codes, 3 * n, LIKE if len(key) > SHORT else LIKE_SHORT) if key else []
            return list(dict.fromkeys(codes[k] for k in like))[:n]

        return keys.map(one)

    return texts.select(column).distinct().withColumn("suggestions", suggest(typed_key(F.col(column))))


def rematch_stations(obs: DataFrame, places: DataFrame) -> DataFrame:
    """Readings under a name instead of a code get the code where exactly one station has the name's letters; another railway's trains are left alone."""
    stations = places.groupBy("code").agg(F.max_by("name", "seq").alias("name"))
    one = stations.groupBy(name_key(F.col("name")).alias("key_")).agg(F.count("*").alias("n_"), F.min("code").alias("found_")).filter("n_ = 1 AND key_ <> ''").drop("n_")
    known = stations.select(F.col("code").alias("station_code"), F.lit(True).alias("known_"))
    joined = obs.join(known, "station_code", "left").withColumn("key_", name_key(F.col("station_code"))).join(one, "key_", "left")
    free = F.col("known_").isNull() & ~F.substring("train_number", 1, 2).isin(*OTHER_RAILWAY)
    code = F.when(free, F.coalesce("found_", "station_code")).otherwise(F.col("station_code"))
    return joined.select(*[code.alias(c) if c == "station_code" else F.col(c) for c in obs.columns])
