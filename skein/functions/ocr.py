"""Rules around text read from images, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least width and height of an image that is read, by mode.
LEAST_SIZE = {"full": (50, 50), "selective": (150, 100), "minimal": (250, 150)}
#: Least confidence of a piece of text, least length of a text that is kept.
LEAST_CONFIDENCE, LEAST_TEXT = 0.5, 6


def mode(kind: Column, chars: Column, pages: Column) -> Column:
    """How thoroughly a file's images are read, by its type and how much text it has: ``full``, ``selective``, ``minimal`` or ``skip``."""
    density = chars / F.greatest(pages, F.lit(1))
    return (
        F.when(kind == "image", "full")
        .when(kind == "pptx", F.when(chars > 1000, "selective").otherwise("full"))
        .when(kind == "excel", F.when(chars > 2000, "minimal").otherwise("selective"))
        .when(chars < 500, "full")
        .when((chars < 3000) | (density < 500), "selective")
        .when(chars < 8000, "minimal")
        .otherwise("skip")
    )


def readable(width: Column, height: Column, how: Column) -> Column:
    """Whether an image is large enough for a mode."""
    out = F.lit(False)
    for name, (w, h) in LEAST_SIZE.items():
        out = F.when(how == name, (width >= w) & (height >= h)).otherwise(out)
    return out


def sure_text(pieces: Column) -> Column:
    """The pieces ``(text, confidence)`` that are sure enough, joined by blanks; empty if little is left."""
    kept = F.transform(F.filter(pieces, lambda p: p["confidence"] > LEAST_CONFIDENCE), lambda p: F.trim(p["text"]))
    said = F.array_join(kept, " ")
    return F.when(F.length(said) >= LEAST_TEXT, said).otherwise("")


def lines_of_segments(segments: Column, near: float = 10.0) -> Column:
    """Segments ``(x, y, text)`` as lines: from top to bottom, a segment joins the line whose first segment is nearer than ``near``; from left to right within a line."""
    by_y = F.sort_array(F.transform(segments, lambda s: F.struct(s["y"].cast("double").alias("y"), s["x"].cast("double").alias("x"), s["text"].alias("text"))))
    one = lambda s: F.struct(s["y"].alias("y"), F.array(F.struct(s["x"].alias("x"), s["text"].alias("text"))).alias("parts"))
    empty = F.slice(F.transform(by_y, one), 1, 0)

    def add(lines: Column, s: Column) -> Column:
        n = F.size(lines)
        last = F.element_at(lines, F.greatest(n, F.lit(1)))
        joined = F.struct(last["y"].alias("y"), F.concat(last["parts"], one(s)["parts"]).alias("parts"))
        return F.when((n > 0) & (s["y"] - F.try_element_at(lines, F.lit(-1))["y"] < near), F.concat(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(lines, F.array(one(s))))

    add_safe = lambda lines, s: F.when(F.size(lines) == 0, F.array(one(s))).otherwise(add(lines, s))
    return F.transform(F.aggregate(by_y, empty, add_safe), lambda ln: F.array_join(F.transform(F.sort_array(ln["parts"]), lambda p: p["text"]), " "))


def without_fenced(text: Column) -> Column:
    """Text without the lines between code fences, and without the fences; an open fence hides the rest."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.startswith(F.ltrim(line), F.lit("```"))
        kept = F.when(fence | acc["inside"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line)))
        return F.struct((acc["inside"] != fence).alias("inside"), kept.alias("kept"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


def collapse_blank_lines(text: Column) -> Column:
    """Several blank lines in a row become one."""
    return F.regexp_replace(text, r"\n(?:[ \t]*\n){2,}", "\n\n")
