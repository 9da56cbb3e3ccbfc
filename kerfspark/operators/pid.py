"""Process diagrams: instrument tags, symbol classes, connectivity and control loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfspark.operators import metrics

# What the first letter of a tag measures; what the letters behind it do; modifiers; letters of final elements.
VARIABLES = {
    "A": "ANALYSIS", "B": "BURNER", "C": "USERSCHOICECONDUCTIVITY", "D": "USERSCHOICEDENSITY", "E": "VOLTAGE", "F": "FLOWRATE", "G": "USERSCHOICEGAUGING",
    "H": "HANDMANUAL", "I": "CURRENTELECTRICAL", "J": "POWER", "K": "TIME", "L": "LEVEL", "M": "USERSCHOICEMOISTURE", "N": "USERSCHOICE", "O": "USERSCHOICE",
    "P": "PRESSURE", "Q": "QUANTITY", "R": "RADIATION", "S": "SPEED", "T": "TEMPERATURE", "U": "MULTIVARIABLE", "V": "VIBRATION", "W": "WEIGHT",
    "X": "UNCLASSIFIED", "Y": "EVENT", "Z": "POSITION",
}
FUNCTIONS = {
    "A": "ALARM", "B": "USERSCHOICE", "C": "CONTROL", "E": "SENSOR", "G": "GLASS", "I": "INDICATE", "K": "CONTROLSTATION", "L": "LIGHT", "N": "USERSCHOICE",
    "O": "ORIFICE", "P": "TESTPOINT", "R": "RECORD", "S": "SWITCH", "T": "TRANSMIT", "U": "MULTIFUNCTION", "V": "VALVE", "W": "WELL", "Y": "RELAY", "Z": "DRIVER",
}
MODIFIERS = {"H": "HIGH", "L": "LOW", "M": "MIDDLE"}
CONTROLLER, TRANSMITTER, FINAL = "C", "T", "VZ"
UNKNOWN = "UNKNOWN_INSTRUMENT"
#: Letters, and digits of the loop's number, that a tag may have.
MOST_LETTERS, MOST_DIGITS = 5, 5


def parts(components: DataFrame, tag: str = "tag") -> DataFrame:
    """Adds letters, variable, functions, loop and suffix: a tag's parts, read from the left (letters, a dash, a space, the loop's number, a letter), all null unless the tag is just that."""
    c = F.col
    read = components.withColumn("_t", F.upper(F.trim(tag)))
    read = read.withColumn("_letters", F.regexp_extract("_t", "^[A-Z]*", 0))
    read = read.withColumn("_rest", F.ltrim(F.substring("_t", F.length("_letters") + 1, F.length("_t")), F.lit("-")))
    read = read.withColumn("_dashes", F.length("_t") - F.length("_letters") - F.length("_rest"))
    read = read.withColumn("_number", F.when(F.substring("_rest", 1, 1).isin(" ", "\t"), F.substring("_rest", F.lit(2), F.length("_rest"))).otherwise(c("_rest")))
    read = read.withColumn("_digits", F.regexp_extract("_number", "^[0-9]*", 0))
    read = read.withColumn("_suffix", F.substring("_number", F.length("_digits") + 1, F.length("_number")))
    keeps = F.length("_letters").between(1, MOST_LETTERS) & (c("_dashes") <= 1) & F.length("_digits").between(1, MOST_DIGITS) & c("_suffix").rlike("^[A-Z]?$")
    read = read.withColumn("_keeps", keeps)
    part = lambda x: F.when(F.col("_keeps"), x)
    out = {"letters": c("_letters"), "variable": F.substring("_letters", 1, 1), "functions": F.substring("_letters", 2, MOST_LETTERS), "loop": c("_digits"), "suffix": F.nullif("_suffix", F.lit(""))}
    return read.select(*components.columns, *[part(x).alias(n) for n, x in out.items()])


def tags(components: DataFrame) -> DataFrame:
    """component_id, tag, variable, functions, loop, symbol_class, and whether the tag is valid: a variable, then letters of functions and modifiers only. Untagged components have nulls."""
    p = parts(components.select("component_id", "tag"))
    known = "".join(sorted({*FUNCTIONS, *MODIFIERS}))
    valid = F.when(F.trim("tag") != "", F.coalesce(F.col("letters").isNotNull() & F.col("functions").rlike(f"^[{known}]*$"), F.lit(False)))
    names = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    letters = F.filter(F.split("functions", ""), lambda x: x != "")
    words = F.transform(letters, lambda x: F.element_at(names(MODIFIERS | FUNCTIONS), x))
    symbol = F.when(F.col("valid"), F.concat_ws("_", F.element_at(names(VARIABLES), F.col("variable")), words)).otherwise(UNKNOWN)
    return p.withColumn("valid", valid).select("component_id", "tag", "variable", "functions", "loop", "valid", symbol.alias("symbol_class"))


def isolated(components: DataFrame, connections: DataFrame) -> DataFrame:
    """Components without any connection."""
    ends = connections.select(F.explode(F.array("src", "dst")).alias("component_id"))
    return components.join(ends, "component_id", "left_anti").select("component_id", "tag")


def loops(components: DataFrame) -> DataFrame:
    """Loops of valid tags with a controller, and whether they have a transmitter and a final element."""
    t = tags(components).where("valid")
    has = lambda letters: F.max(F.col("functions").rlike(f"[{letters}]"))
    by = t.groupBy("loop").agg(has(CONTROLLER).alias("c"), has(TRANSMITTER).alias("t"), has(FINAL).alias("v"), F.count(F.lit(1)).alias("components"))
    return by.where("c").select("loop", "components", F.col("t").alias("has_transmitter"), F.col("v").alias("has_final_element"), (F.col("t") & F.col("v")).alias("complete"))


def findings(components: DataFrame, connections: DataFrame) -> DataFrame:
    """(rule_id, severity, node) of all diagram checks: invalid tags, components without connection, incomplete loops with each of their controllers."""
    row = lambda d, rule, severity, node: d.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(node).cast("string").alias("node"))
    bad = loops(components).where("not complete").select("loop")
    controllers = tags(components).where(F.col("valid") & F.col("functions").contains(CONTROLLER)).join(bad, "loop", "left_semi")
    return row(tags(components).where("not valid"), "PID-TAG-001", "ERROR", "component_id").unionByName(row(isolated(components, connections), "PID-CONN-001", "ERROR", "component_id")).unionByName(row(controllers, "PID-LOOP-001", "WARNING", "component_id"))


def symbol_scores(components: DataFrame, human: str) -> DataFrame:
    """Agreement of the symbol classes that tags imply with those that people gave (column ``human``); passed from a macro F1 of 0.80 over the classes that occur."""
    t = tags(components).select("component_id", F.col("symbol_class").alias("_said")).join(components.select("component_id", F.col(human).alias("_is")), "component_id").where("_is is not null")
    s = metrics.summary(metrics.confusion(t, "_is", "_said"))
    return s.withColumn("passed", F.col("macro_f1_present") >= 0.80)
