"""Coordinates, boxes and interface actions as column expressions, all of them in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import strip

POINTER = ("CLICK", "DOUBLE_CLICK", "RIGHT_CLICK", "DRAG", "MOVE")
WITH_PAYLOAD = ("TYPE", "KEY", "SCROLL", "WAIT", "KEY_DOWN", "KEY_UP")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def norm_bbox(box: Column, width: Column, height: Column) -> Column:
    """Box of four numbers with corners in order, in parts of the screen; null for another size or for nulls."""
    largest = F.array_max(F.transform(box, lambda v: F.abs(v)))
    pixels = largest > 1.5
    scale = lambda i, d: clamp01(F.when(pixels, box[i] / F.greatest(d, F.lit(1))).otherwise(box[i]))
    x1, y1, x2, y2 = scale(0, width), scale(1, height), scale(2, width), scale(3, height)
    ok = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())
    return F.when(ok, F.array(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))


def bbox_centre(box: Column) -> Column:
    return F.when(F.size(box) == 4, F.array(clamp01((box[0] + box[2]) / 2), clamp01((box[1] + box[3]) / 2)))


def norm_point(point: Column, width: Column, height: Column, limit: float = 1.5) -> Column:
    """Point in parts of the screen; divided by the screen's size only if a value exceeds the limit."""
    pixels = F.greatest(point[0], point[1]) > limit
    part = lambda i, d: clamp01(F.when(pixels, point[i] / F.greatest(d, F.lit(1))).otherwise(point[i]))
    return F.when((F.size(point) >= 2) & point[0].isNotNull() & point[1].isNotNull(), F.array(part(0, width), part(1, height)))


def action_point(action: Column, width: Column, height: Column) -> Column:
    """Point of the first click or move in an action's text, in parts of the screen; null if it has none."""
    call = r"(?:click|doubleClick|moveTo)\s*\(\s*([0-9.]+)\s*,\s*([0-9.]+)"
    x, y = (F.regexp_extract(action, call, g).try_cast("double") for g in (1, 2))
    return norm_point(F.when(x.isNotNull() & y.isNotNull(), F.array(x, y)), width, height, 1.0)


#: Calls that tell an action's operation, the first that occurs in the text without blanks counts.
CALLS = (("CLICK", ("click(", "doubleclick(")), ("TYPE", ("write(", "typewrite(")), ("KEY", ("hotkey(", "press(", "keydown(", "keyup(")), ("SCROLL", ("scroll(", "hscroll(")), ("DRAG", ("dragto(", "dragrel(")), ("MOVE", ("moveto(", "move(")))


def classify_action(action: Column, drag: bool = True) -> Column:
    """Operation that an action's text calls. Without ``drag`` drags count as moves."""
    a = F.replace(F.lower(F.coalesce(action, F.lit(""))), F.lit(" "), F.lit(""))
    out = F.lit("OTHER")
    for name, calls in reversed(CALLS):
        hit = F.lit(False)
        for call in calls:
            hit |= a.contains(call)
        out = F.when(hit, name if drag or name != "DRAG" else "MOVE").otherwise(out)
    return out


def operation_name(value: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(value)), F.lit("")), F.lit("OTHER"))


def patch_index(point: Column, side: int) -> Column:
    cell = lambda v: F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), v)) * side)
    return (cell(point[1]) * side + cell(point[0])).cast("int")


def pixel(part: Column, size: Column) -> Column:
    """Pixel of a part of the screen, rounded half to even."""
    return F.bround(clamp01(part) * (size - 1), 0).cast("int")


def fit_side(width: Column, height: Column, most: int = 1280) -> Column:
    """Size of an image whose larger side is at most so many pixels."""
    factor = F.least(F.lit(1.0), F.lit(most) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), F.bround(v * factor, 0).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def summarize_action(operation: Column, coord: Column, coord2: Column, payload: Column) -> Column:
    """Short text of an action: operation with its point to three digits if it points, both points of a drag, else the
    payload on one line, cut to 64 characters."""
    ok = lambda c: F.coalesce((F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull(), F.lit(False))
    at = lambda c: F.concat(F.call_function("format_number", c[0], F.lit("0.000")), F.lit(","), F.call_function("format_number", c[1], F.lit("0.000")))
    text = strip(F.replace(F.coalesce(payload, F.lit("")), F.lit("\n"), F.lit(" ")))
    text = F.when(F.length(text) > 64, F.concat(F.substring(text, 1, 61), F.lit("..."))).otherwise(text)
    pointed = operation.isin("MOVE", "CLICK", "DOUBLE_CLICK", "RIGHT_CLICK")
    out = F.when(pointed & ok(coord), F.concat(operation, F.lit("@"), at(coord)))
    out = out.when((operation == "DRAG") & ok(coord) & ok(coord2), F.concat(operation, F.lit("@"), at(coord), F.lit("->"), at(coord2)))
    return out.when(text != "", F.concat(operation, F.lit(":"), text)).otherwise(operation)


def action_error(operation: Column, coord: Column, coord2: Column, payload: Column) -> Column:
    """What is wrong with an action, or null: pointers need a point within the screen, texts need a payload."""
    inside = lambda c: (F.size(c) >= 2) & F.coalesce(c[0].between(0, 1) & c[1].between(0, 1), F.lit(False))
    known = operation.isin(*POINTER, *WITH_PAYLOAD, "DONE")
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown operation")
        .when(operation.isin(*POINTER) & ~F.coalesce(inside(coord), F.lit(False)), "no point within the screen")
        .when((operation == "DRAG") & ~F.coalesce(inside(coord2), F.lit(False)), "no second point")
        .when(operation.isin("TYPE", "KEY") & (F.coalesce(payload, F.lit("")) == ""), "no payload")
    )


_QUOTED = r"'(?:[^'\\]|\\.)*'|\x22(?:[^\x22\\]|\\.)*\x22"
#: A call of the automation library: its name and its arguments.
CALL = rf"pyautogui\.(\w+)\(((?:{_QUOTED}|[^()'\x22])*)\)"
_NUMBER = r"-?\d+(?:\.\d*)?"


def _number(arguments: Column, place: int, name: str) -> Column:
    """A number that a call has at a place or under a name; null if there is none."""
    first = F.regexp_extract(arguments, rf"^\s*{r'[^,=]*,' * place}\s*({_NUMBER})\s*(?:,|$)", 1)
    named = F.regexp_extract(arguments, rf"(?:^|,)\s*{name}\s*=\s*({_NUMBER})\s*(?:,|$)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(named, F.lit(""))).try_cast("double")


def _text(quoted: Column) -> Column:
    """Text of a quoted string, with its escapes resolved."""
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    inner = F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.replace(F.regexp_replace(inner, r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


def parsed_action(source: Column, width: Column, height: Column) -> Column:
    """``struct<operation, coord, coord2, payload>`` of recorded automation code; null if it calls nothing known.

    A move followed by a drag, both with points, is a drag; otherwise the last call decides. Points are parts of the
    screen. A click of two or more clicks is a double click. Keys of a hotkey are joined, of a press the first counts;
    scrolls have whole amounts. Everything stays in the JVM.
    """
    names, arguments = (F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(CALL), g) for g in (1, 2))
    part = lambda v, d: clamp01(v / F.greatest(d - 1, F.lit(1)))
    point = lambda a: F.when(_number(a, 0, "x").isNotNull() & _number(a, 1, "y").isNotNull(), F.array(part(_number(a, 0, "x"), width), part(_number(a, 1, "y"), height)))
    none = F.lit(None).cast("array<double>")
    row = lambda op, coord=none, coord2=none, payload=F.lit(""): F.struct((F.lit(op) if isinstance(op, str) else op).alias("operation"), coord.alias("coord"), coord2.alias("coord2"), payload.alias("payload"))
    calls = F.arrays_zip(names.alias("n"), arguments.alias("a"))
    pairs = F.zip_with(calls, F.slice(F.concat(calls, F.array(F.lit(None))), 2, F.size(calls)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    drags = F.filter(pairs, lambda p: (p["x"]["n"] == "moveTo") & (p["y"]["n"] == "dragTo") & point(p["x"]["a"]).isNotNull() & point(p["y"]["a"]).isNotNull())
    drag = F.transform(F.slice(drags, 1, 1), lambda p: row("DRAG", point(p["x"]["a"]), point(p["y"]["a"])))

    def one(c: Column) -> Column:
        name, a = c["n"], c["a"]
        at = point(a)
        right = (name == "rightClick") | (F.lower(F.regexp_extract(a, r"button\s*=\s*['\x22](\w+)", 1)) == "right")
        twice = (name == "doubleClick") | (F.coalesce(_number(a, 9, "clicks"), F.lit(1.0)) >= 2)
        click = F.when(name == "moveTo", "MOVE").when(twice, "DOUBLE_CLICK").when(right, "RIGHT_CLICK").otherwise("CLICK")
        first = _text(F.regexp_extract(a, rf"^\s*(?:message\s*=\s*)?({_QUOTED})", 1))
        keys = F.transform(F.regexp_extract_all(a, F.lit(rf"(?:^|,)\s*({_QUOTED}|-?\d+)\s*(?=,|$)"), 1), lambda k: F.when(k.rlike(r"^['\x22]"), _text(k)).otherwise(k))
        keys = F.when(name == "press", F.slice(keys, 1, 1)).otherwise(keys)
        amount = _number(a, 0, "clicks").cast("long").cast("string")
        return (
            F.when(name.isin("click", "doubleClick", "rightClick", "moveTo") & at.isNotNull(), row(click, at))
            .when(name.isin("write", "typewrite") & (first != ""), row("TYPE", payload=first))
            .when(name.isin("hotkey", "press") & (F.size(keys) > 0), row("KEY", payload=F.array_join(keys, "+")))
            .when(name.isin("keyDown", "keyUp") & a.rlike(rf"^\s*(?:{_QUOTED})"), row(F.when(name == "keyDown", "KEY_DOWN").otherwise("KEY_UP"), payload=first))
            .when(name.isin("scroll", "hscroll") & amount.isNotNull(), row("SCROLL", payload=F.when(name == "hscroll", F.concat(amount, F.lit(",0"))).otherwise(F.concat(F.lit("0,"), amount))))
        )

    last = F.transform(F.slice(F.reverse(calls), 1, 1), one)
    return F.coalesce(F.try_element_at(drag, F.lit(1)), F.try_element_at(last, F.lit(1)))


def key_names(payload: Column) -> Column:
    """Keys of a payload, parted by plus signs and commas."""
    return F.filter(F.transform(F.split(payload, "[+,]"), strip), lambda k: k != "")


def runtime_action(operation: Column, coord: Column, coord2: Column, payload: Column) -> Column:
    """``struct<type, x, y, x2, y2, text, keys, scroll_x, scroll_y, seconds>`` that an operation runs as.

    Texts and keys without a payload wait 0.15 seconds; a wait has the first number of its payload, 0.25 without
    one, between 0.05 and 5; a scroll has the last two of its payload's first numbers; unknown operations end.
    """
    pay = F.coalesce(payload, F.lit(""))
    keys, text = key_names(pay), strip(pay)
    typed = operation == "TYPE"
    pressed = operation.isin("KEY", "KEY_DOWN", "KEY_UP")
    idle = typed & (text == "") | pressed & (F.size(keys) == 0)
    whole = F.regexp_extract_all(pay, F.lit(r"(-?\d+)"), 1)
    number = lambda i: F.try_element_at(whole, F.lit(i)).try_cast("int")
    sx = F.when(F.size(whole) >= 2, number(1)).otherwise(F.lit(0))
    sy = F.when(F.size(whole) >= 2, number(2)).when(F.size(whole) == 1, number(1)).otherwise(F.lit(0))
    seconds = F.least(F.lit(5.0), F.greatest(F.lit(0.05), F.coalesce(F.nullif(F.regexp_extract(pay, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.25))))
    points, drags, scrolls = operation.isin(*POINTER), operation == "DRAG", operation == "SCROLL"
    kind = F.when(idle, "WAIT").when(points | typed | pressed | scrolls | (operation == "WAIT"), operation).otherwise("DONE")
    return F.struct(
        kind.alias("type"), *(F.when(when, F.try_element_at(c, F.lit(i))).alias(n) for when, c, i, n in ((points, coord, 1, "x"), (points, coord, 2, "y"), (drags, coord2, 1, "x2"), (drags, coord2, 2, "y2"))),
        F.when(typed & ~idle, text).alias("text"), F.when(pressed & ~idle, keys).alias("keys"), F.when(scrolls, sx).alias("scroll_x"), F.when(scrolls, sy).alias("scroll_y"),
        F.when(idle, F.lit(0.15)).when(operation == "WAIT", seconds).alias("seconds"),
    )


#: Names that recorded plans have for operations.
PLAN_OPERATIONS = {"left_click": "CLICK", "double_click": "DOUBLE_CLICK", "right_click": "RIGHT_CLICK", "left_click_drag": "DRAG", "scroll": "SCROLL", "type": "TYPE", "key": "KEY", "mouse_move": "MOVE", "wait": "WAIT", "terminate": "DONE"}


def plan_operation(name: Column) -> Column:
    """Operation of a plan's action name; null if it is unknown."""
    table = F.create_map(*(F.lit(x) for pair in PLAN_OPERATIONS.items() for x in pair))
    return F.try_element_at(table, F.lower(F.coalesce(name, F.lit(""))))


def plan_action(operation: Column, coordinate: Column, start: Column, text: Column, keys: Column, scroll_x: Column, scroll_y: Column, direction: Column, seconds: Column, status: Column) -> Column:
    """``struct<operation, coord, coord2, payload>`` of a plan's arguments; null where a needed one is missing.

    Points above 1.5 are in thousandths (0 to 999). A scroll without an amount goes three steps in its direction.
    """

    def point(c: Column) -> Column:
        large = (F.abs(c[0]) > 1.5) | (F.abs(c[1]) > 1.5)
        part = lambda v: clamp01(F.when(large, v / 999.0).otherwise(v))
        return F.when((F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull(), F.array(part(c[0]), part(c[1])))

    none = F.lit(None).cast("array<double>")
    row = lambda coord=none, coord2=none, payload=F.lit(""): F.struct(operation.alias("operation"), coord.alias("coord"), coord2.alias("coord2"), payload.alias("payload"))
    to = F.lower(F.coalesce(direction, F.lit("")))
    dx, dy = F.coalesce(scroll_x, F.lit(0)), F.coalesce(scroll_y, F.lit(0))
    dy = F.when((dy == 0) & to.isin("up", "north"), 3).when((dy == 0) & to.isin("down", "south"), -3).otherwise(dy)
    dx = F.when((dx == 0) & to.isin("left", "west"), -3).when((dx == 0) & to.isin("right", "east"), 3).otherwise(dx)
    return (
        F.when(operation.isin("CLICK", "DOUBLE_CLICK", "RIGHT_CLICK", "MOVE") & point(coordinate).isNotNull(), row(point(coordinate)))
        .when((operation == "DRAG") & point(start).isNotNull() & point(coordinate).isNotNull(), row(point(start), point(coordinate)))
        .when((operation == "TYPE") & (text != ""), row(payload=text)).when((operation == "KEY") & (keys != ""), row(payload=keys))
        .when(operation == "SCROLL", row(payload=F.concat(dx.cast("string"), F.lit(","), dy.cast("string"))))
        .when(operation == "WAIT", row(payload=F.coalesce(seconds, F.lit("1")))).when(operation == "DONE", row(payload=F.coalesce(F.nullif(status, F.lit("")), F.lit("success"))))
    )
