"""What layer names tell: type, depth and thickness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of layer names by type, in order of precedence.
LAYER_PREFIXES = {
    "cut": ["CUT", "CUT_", "PROFILE", "OUTLINE", "OUTER", "CONTOUR"],
    "drill": ["DRILL", "HOLE", "BORE", "PUNCH"],
    "pocket": ["POCKET", "GROOVE", "SLOT", "DADO", "RABBET"],
    "border": ["BORDER", "SHEET", "STOCK", "MATERIAL"],
    "engrave": ["ENGRAVE", "ETCH", "SCORE", "MARK"],
}
# Plausible millimetres of a depth and of a thickness.
DEPTH_MM, THICKNESS_MM = (0.1, 100.0), (3.0, 80.0)


def layer_type(layer: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """Type of the first prefix that the name begins with."""
    name = F.upper(F.trim(layer))
    out = F.lit("unknown")
    for kind, begins in reversed(list((prefixes or LAYER_PREFIXES).items())):
        out = F.when(name.rlike("^(?:" + "|".join(begins) + ")"), kind).otherwise(out)
    return out


def layer_type_longest(layer: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """Type of the longest prefix that the name begins with."""
    name = F.upper(F.trim(layer))
    pairs = sorted(((len(p), p, kind) for kind, begins in (prefixes or LAYER_PREFIXES).items() for p in begins), key=lambda x: x[0])
    out = F.lit("unknown")
    for _, p, kind in pairs:
        out = F.when(name.startswith(p), kind).otherwise(out)
    return out


def tokens(layer: Column) -> Column:
    """A name in capitals as its runs of letters, numbers and anything else; P or V between digits is a decimal point."""
    pointed = F.regexp_replace(F.upper(layer), "([0-9])[PV](?=[0-9])", "$1.")
    return F.regexp_extract_all(pointed, F.lit("[A-Z]+|[0-9]+(?:[.][0-9]+)?|[^A-Z0-9]+"), F.lit(0))


def _at(t: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(t, i))


def _ends(t: Column, i: Column) -> Column:
    """Whether a word ends before the token: there is none, or it begins with a character that no word holds."""
    return F.coalesce(~_at(t, i).rlike("^[A-Z0-9_]"), F.lit(True))


def _short(number: Column) -> Column:
    return F.length(F.substring_index(number, ".", 1)) <= 3


def _first(values: Column, bounds: tuple[float, float]) -> Column:
    return F.get(F.filter(values, lambda x: x.between(*bounds)), F.lit(0))


def marked_size(layer: Column, words: list[str], bounds: tuple[float, float]) -> Column:
    """The first plausible number after one of the words, with nothing or spaces, ``_``, ``=``, ``:`` or ``-`` between."""
    t = tokens(layer)

    def value(token: Column, i: Column) -> Column:
        loose = _at(t, i - 1).rlike("^[ \\t\\n\\r_=:-]+$")
        word = F.when(loose, _at(t, i - 2)).otherwise(_at(t, i - 1))
        # a number with letters right behind it counts up to its point only
        whole = F.when(_ends(t, i + 1), token).when(token.contains("."), F.substring_index(token, ".", 1))
        return F.when(token.rlike("^[0-9]") & word.isin(words) & _short(token), whole.cast("double"))

    return _first(F.transform(t, value), bounds)


def bare_size(layer: Column, bounds: tuple[float, float]) -> Column:
    """The first plausible number of millimetres: a number with the word MM behind it."""
    t = tokens(layer)

    def value(token: Column, i: Column) -> Column:
        spaced = _at(t, i + 1).rlike("^[ \\t\\n\\r]+$")
        unit = F.when(spaced, _at(t, i + 2)).otherwise(_at(t, i + 1))
        ends = F.when(spaced, _ends(t, i + 3)).otherwise(_ends(t, i + 2))
        fresh = F.coalesce(~_at(t, i - 1).endswith("."), F.lit(True))
        return F.when(token.rlike("^[0-9]") & (unit == "MM") & ends & fresh & _short(token), token.cast("double"))

    return _first(F.transform(t, value), bounds)


# Words that announce a depth and a thickness; types of layers whose sizes are depths.
DEPTH_WORDS = ["DEPTH", "DEEP", "DP", "D"]
THICKNESS_WORDS = ["THICKNESS", "THICK", "THK", "STAERKE", "STARKE", "ST", "S", "T"]
DEPTH_TYPES = ["pocket", "engrave", "drill"]


def depth_from_layer(layer: Column, kind: Column | None = None) -> Column:
    """An announced depth, else a bare size where the layer's type means depths (or isn't known to the caller)."""
    bare = bare_size(layer, DEPTH_MM)
    return F.coalesce(marked_size(layer, DEPTH_WORDS, DEPTH_MM), bare if kind is None else F.when(kind.isNull() | kind.isin(DEPTH_TYPES), bare))


def thickness_from_layer(layer: Column) -> Column:
    return F.coalesce(marked_size(layer, THICKNESS_WORDS, THICKNESS_MM), bare_size(layer, THICKNESS_MM))
