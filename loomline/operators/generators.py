"""Deterministic generated conversations: each is a function of a row's number, so a table drives how many there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.chat import CALL, CALL_END, FINAL, RESULT, message


def tool_loop(i: Column) -> Column:
    """Addition through a tool: question, call, result and answer, Turkish for even numbers and English for odd ones."""
    a, b = (i * 17 + 3) % 997, (i * 29 + 11) % 997
    turkish = i % 2 == 0
    ask = F.when(turkish, F.format_string("%d ile %d sayısını topla.", a, b)).otherwise(F.format_string("Add %d and %d.", a, b))
    call = F.format_string(CALL + '{"arguments":{"a":%d,"b":%d},"name":"add"}' + CALL_END, a, b)
    result = F.format_string(RESULT + '{"ok":true,"value":%d}' + CALL_END, a + b)
    say = F.when(turkish, F.format_string("Sonuç %d.", a + b)).otherwise(F.format_string("The result is %d.", a + b))
    return F.array(message("user", ask), message("assistant", call), message("tool", result), message("assistant", F.concat(F.lit(FINAL), say)))


def mixed_radix(i: Column, sizes: list[int]) -> list[Column]:
    """Digits of a number in mixed radix, the first fastest."""
    out, rest = [], i
    for n in sizes:
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return out


#: Parts of the self-description, in Turkish.
OPENINGS = ("Ben yerel bir yardımcıyım", "Burada bir yardımcı olarak varım", "Sana eşlik eden yardımcıyım", "Karşında bir yardımcı var", "Bana yardımcı denir", "Yardımcın benim")
ABILITIES = ("soruları yanıtlarım", "metinleri düzenlerim", "kod yazarım", "bilgileri birleştiririm", "adımları planlarım", "sonuçları denetlerim")
CLOSINGS = ("Nasıl yardımcı olayım?", "Sıradaki iş nedir?", "Başlayalım mı?", "Hazırım.", "Dinliyorum.", "Ne yapalım?")


def identity_surface(i: Column) -> Column:
    """One of the combinations of opening, ability and closing."""
    a, b, c = mixed_radix(i, [len(OPENINGS), len(ABILITIES), len(CLOSINGS)])
    pick = lambda words, k: F.array(*map(F.lit, words))[k]
    return F.concat(pick(OPENINGS, a), F.lit(", "), pick(ABILITIES, b), F.lit(". "), pick(CLOSINGS, c))


def curriculum_mode(i: Column, modes: int = 24) -> tuple[Column, Column, Column]:
    """Mode, language and whether the inner representation is trained, of a curriculum row."""
    block = F.floor(i / modes)
    return (i % modes).cast("int"), F.when(block % 2 == 0, "tr").otherwise("en"), F.floor(block / 2) % 2 == 0


DEBUG_CASES = ("off_by_one", "null_check", "wrong_sign", "bad_import", "shadowed_name", "missing_return", "bad_index", "stale_cache")


def debug_steps(i: Column) -> Column:
    """A debugging trajectory: plan, look, edit, test and final answer, varied by the row's number."""
    case, tool, style, depth = mixed_radix(i, [8, 4, 4, 6])
    names = F.array(*map(F.lit, DEBUG_CASES))
    tools = F.array(*(F.lit(x) for x in ("read_file", "search", "run_tests", "apply_patch")))
    body = F.transform(F.sequence(F.lit(0), depth), lambda k: message("assistant", F.concat(F.lit("<|plan|>"), F.format_string("step %d: use %s on %s", k, tools[(tool + k) % 4], names[case]))))
    return F.concat(F.array(message("user", F.format_string("Fix %s (style %d).", names[case], style))), body, F.array(message("assistant", F.concat(F.lit(FINAL), F.format_string("%s is fixed.", names[case])))))
