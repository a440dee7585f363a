"""Native text functions. All are Catalyst expressions: no Python runs on the executors.

Regular expressions carry (?U) for Unicode classes and (?d) where only \\n may end a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

NBSP, NNBSP = "\u00a0", "\u202f"
WORD = r"(?U)[^\W\d_][\w'’\-]*"

# --- fixed values: function words, names and nouns that the checks know -----------------
EN_FUNCTION_WORDS = (
    "the and of to is are this that with for you your from which when can will be by an it its or not if as on at was were have has into "
    "these those such then there their they them using use used also only must should would could does do how what where while"
).split()
FR_FUNCTION_WORDS = (
    "le la les de des du et est sont ce cette que qui avec pour vous votre vos dans un une par sur pas ne se si au aux il elle ils on lors "
    "peut peuvent être été ou plus"
).split()
RO_FUNCTION_WORDS = "și sau în din cu pe la de care este sunt pentru că se nu un o al ale prin dacă mai".split()
TITLE_NAMES = ("Oxygen", "XML", "Auteur", "Author", "Texte", "Grille", "Web", "DITA", "Eclipse", "Java", "Windows", "Mac", "Linux", "Git")
UI_NOUNS = (
    "dialogue vue onglet panneau menu mode outils assistant fenêtre section page champ bouton option perspective éditeur barre"
).split()
#: (name, pattern, what to write instead)
CALQUES = (
    ("librairie=library", r"\blibrairies?\b", "bibliothèque"),
    ("supporter=support", r"\bsupport(?:e|es|ent|er|é|ée|és|ées|ait|aient|ant)\b", "prendre en charge"),
    ("éditer=edit", r"\bédit(?:er|e|es|ez|ons|ent|é|ée|és|ées|ant|ait|aient)\b", "modifier"),
    ("sauver=save", r"\bsauv(?:er|e|es|ez|é|ée|és|ées|ant)\b", "enregistrer"),
    ("cliquer X=click X", r"\bcliqu(?:ez|er|e|ant)\s+(?:le|la|les|l['’]|un|une|deux|droit sur sur)\b", "cliquer sur"),
    ("appuyer X=press X", r"\bappuy(?:ez|er|ant)\s+(?:le|la|les|l['’])\b", "appuyer sur"),
    ("le dialogue=dialog", r"\b(?:le|du|au|ce|un|les|des|ces)\s+dialogues?\b", "boîte de dialogue"),
    ("customiser=customize", r"\bcustomis\w*|\bcustomiz\w*", "personnaliser"),
    ("initier=initiate", r"\biniti(?:er|ez|e|é|ée|és|ées|ant)\b", "lancer, démarrer"),
    ("consistant=consistent", r"\bconsistan(?:t|te|ts|tes|ce)\b", "cohérent"),
    ("processer=process", r"\bprocess(?:er|ez|é|ée|és|ées|ant)\b", "traiter"),
    ("digital=digital", r"\bdigita(?:l|le|ux|les)\b", "numérique"),
    ("opportunité=opportunity", r"\bopportunités?\b", "occasion"),
    ("adresser=address (an issue)", r"\badress(?:er|ez|e|é|ée|és|ées)\s+(?:le|la|les|ce|ces|un|une)\s+(?:problème|question|bogue)", "résoudre"),
)
ROOT_MARKERS = ("<?xml", "<!DOCTYPE", "<topic", "<task", "<concept", "<reference", "<troubleshooting", "<glossentry", "<glossgroup")
# ---------------------------------------------------------------------------------------


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def clean_output(x: Column) -> Column:
    """An answer without its thinking and without a fence around it."""
    bare = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(bare, r"(?d)\A\s*```[a-zA-Z]*\s*\n|\n?```\s*\z", ""))


def extract_xml(x: Column) -> Column:
    """From the earliest root mark on; without one the text itself."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?si)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"(?i)```(?:xml)?\s*|```", "")
    at = F.least(*[F.nullif(F.instr(bare, m), F.lit(0)) for m in ROOT_MARKERS])
    return strip(F.when(at.isNull(), bare).otherwise(F.substring(bare, at, F.length(bare))))


def expand_nbsp(x: Column, narrow: bool = False) -> Column:
    """References to the no-break space (and to the narrow one) as characters."""
    out = F.regexp_replace(x, r"(?i)&nbsp;|&#0*160;|&#x0*a0;", NBSP)
    return F.regexp_replace(out, r"(?i)&#8239;|&#x202f;", NNBSP) if narrow else out


def prolog(x: Column) -> Column:
    """What stands before the root element."""
    return F.regexp_extract(x, r"(?s)\A(.*?)(?:<(?![?!]).*)?\z", 1)


def body(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)<(?![?!]).*", 0)


def norm(x: Column) -> Column:
    """One space for any run of white space, none at the ends."""
    flat = F.translate(F.coalesce(x, F.lit("")), NBSP + NNBSP, "  ")
    return F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))


def strip_doctype(x: Column) -> Column:
    """Without the document type declaration; an internal subset may be one bracket deep."""
    return F.regexp_replace(x, r"(?s)\A(.*?)<!DOCTYPE[^\[\]>]*(?:\[[^\[\]]*\][^\[\]>]*)?>", "$1")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_doctype(x), r"<\?xml[^>]*\?>", " "), r"<[^>]+>", " ")


def excerpt(x: Column, at: Column, around: int = 12) -> Column:
    """Characters around a place (from 0), with no-break spaces made visible."""
    start = F.greatest(at - around, F.lit(0))
    cut = F.substring(x, start + 1, at + around + 1 - start)
    return F.replace(F.replace(cut, F.lit(NBSP), F.lit("<NBSP>")), F.lit(NNBSP), F.lit("<NNBSP>"))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), 0)


def high_marks(x: Column) -> Column:
    """The : ; ! ? used as punctuation, each with up to two characters before it."""
    return F.regexp_extract_all(x, F.lit(rf"(?dU).?[ {NBSP}{NNBSP}]?[:;!?](?=\s|$|[)\]»§])"), 0)


def _bad_mark(m: Column) -> Column:
    mark, before, first, second = F.right(m, F.lit(1)), F.length(m) - 1, F.substring(m, 1, 1), F.substring(m, 2, 1)
    has_space = (before == 2) & second.isin(NBSP, NNBSP)
    cluster = mark.isin("!", "?") & (before > 0) & first.isin("!", "?")
    numeral = (mark == ":") & (before > 0) & first.rlike(r"(?U)^\d$")
    return ~(has_space | cluster | (before == 0) | numeral)


def typography(x: Column) -> Column:
    """struct(nbsp_missing, guillemet_space, en_quotes, total)."""
    missing = F.size(F.filter(high_marks(x), _bad_mark))
    guillemets = F.regexp_count(x, F.lit(f"«(?![{NBSP}{NNBSP}])")) + F.regexp_count(x, F.lit(f"(?<![{NBSP}{NNBSP}])»"))
    quotes = F.regexp_count(x, F.lit(r'"[^"\n]{1,80}"|“[^”\n]{1,80}”'))
    three = F.struct(missing.alias("m"), guillemets.alias("g"), quotes.alias("q"))
    named = lambda t: F.struct(t["m"].alias("nbsp_missing"), t["g"].alias("guillemet_space"), t["q"].alias("en_quotes"), (t["m"] + t["g"] + t["q"]).alias("total"))
    return let(three, named)


def calques(x: Column) -> Column:
    """map(name, count) of the anglicisms found."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n, *_ in CALQUES]), F.array(*[F.regexp_count(x, F.lit("(?iU)" + p)) for _, p, _ in CALQUES]))
    return F.map_filter(pairs, lambda _, n: n > 0)


def _upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def titlecase(source: Column, hyp: Column) -> Column:
    """Words of a title that are capitalised without need."""

    def count(both: Column) -> Column:
        known, ws = both["known"], both["ws"]

        def bad(w: Column, i: Column) -> Column:
            base = F.regexp_extract(w, r"([^'’]*)\z", 1)
            base = F.when(base == "", w).otherwise(base)
            listed = F.array_contains(known, w) | F.array_contains(known, base) | w.isin(*TITLE_NAMES) | base.isin(*TITLE_NAMES)
            after_noun = F.lower(F.get(ws, i - 1)).isin(*UI_NOUNS)
            return (i > 0) & (F.length(w) >= 2) & _upper(F.substring(w, 1, 1)) & ~_upper(w) & ~F.coalesce(after_noun, F.lit(False)) & ~listed & ~F.substring(w, F.lit(2), F.length(w)).rlike(r"\p{Lu}")

        return F.size(F.filter(ws, bad))

    return let(F.struct(words(source).alias("known"), words(hyp).alias("ws")), count)


def function_word_ratio(x: Column, these: list[str], others: list[str], least: int = 3) -> Column:
    """These among both lists' words, 0 with fewer than ``least`` of them."""
    tokens = F.filter(F.transform(words(x), F.lower), lambda w: w.isin(*these, *others))

    def ratio(t: Column) -> Column:
        return F.when(F.size(t) < least, F.lit(0.0)).otherwise(F.size(F.filter(t, lambda w: w.isin(*these))) / F.size(t))

    return let(tokens, ratio)


def english_ratio(x: Column) -> Column:
    return function_word_ratio(x, EN_FUNCTION_WORDS, FR_FUNCTION_WORDS)


def romanian_fluency(x: Column) -> Column:
    """1 to 5 by the share of Romanian among Romanian and English function words."""
    r = function_word_ratio(x, RO_FUNCTION_WORDS, EN_FUNCTION_WORDS, 1)
    return F.when(r >= 0.85, 5).when(r >= 0.7, 4).when(r >= 0.5, 3).when(r >= 0.3, 2).otherwise(1)


def unspaced_marks(x: Column) -> Column:
    """High marks whose previous character is no U+00A0, at the start of the text too."""
    return F.regexp_count(x, F.lit(f"(?<!{NBSP})[?!:;]"))


def spaced_marks(x: Column) -> Column:
    return F.regexp_count(x, F.lit(f"(?<={NBSP})[?!:;]"))


def fix_spacing(x: Column) -> Column:
    """No-break spaces before high marks and inside guillemets, for text without markup."""
    space = f"[ {NBSP}{NNBSP}]"
    gap = f"{space}?"
    # a colon after a digit stays as it is, with or without a space between
    spot = rf"(?:(?<!\d){space}(?=:)|(?<!\d|{space})(?=:)|{gap}(?=[;!?]))"
    out = F.regexp_replace(x, rf"(?dU){spot}([:;!?])(?=\s|$|[)\]»])", f"{NBSP}$1")
    out = F.regexp_replace(out, f"«{gap}", f"«{NBSP}")
    return F.regexp_replace(out, f"{gap}»", f"{NBSP}»")


def segment_id(x: Column) -> Column:
    return F.concat(F.lit("seg-"), F.substring(F.sha1(x.cast("binary")), 1, 10))


def hash_order(seed: int, key: Column) -> Column:
    """A sort key that shuffles: equal on every cluster and for every partitioning."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def coin(seed: int, key: Column) -> Column:
    """A fair coin per key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 1), 16, 10).cast("int") % 2 == 1


def json_object(x: Column) -> Column:
    """The first {...} of free text, outermost braces."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def numeric_score(x: Column) -> Column:
    """A judge's score that may be text such as n/a."""
    return x.try_cast("double")


def any_timestamp(x: Column) -> Column:
    """Epoch seconds, ISO with Z, or ISO local time, as a timestamp."""
    return F.coalesce(F.timestamp_seconds(x.try_cast("double")), F.try_to_timestamp(x))


def split_label(path: Column) -> Column:
    """``test`` from ``.../test_outputs.jsonl``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")[0]


def messages(system: str, user: Column, task: Column | None = None) -> Column:
    """Chat messages; repair and noop tasks say so before the text."""
    lead = F.lit("")
    if task is not None:
        lead = F.when(task == "repair", F.lit("Repair the typography of this document.\n")).when(task == "noop", F.lit("Return this document as it is if nothing is wrong.\n")).otherwise("")
    row = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(row("system", F.lit(system)), row("user", F.concat(lead, user)))


def completion_labels(prompt: Column, completion: Column, most: int) -> Column:
    """Labels of prompt and completion ids: the prompt is masked; null if it fills the length."""
    whole = F.concat(F.transform(prompt, lambda _: F.lit(-100)), completion)
    return F.when(F.size(prompt) < most, F.slice(whole, 1, most))


def alternation(names: Column) -> Column:
    """A pattern that matches any of the names at the end of a dotted path."""
    return F.concat(F.lit(r"(?:^|.*\.)(?:"), F.array_join(F.array_sort(names), "|"), F.lit(")$"))


def family(name: Column, prefixes: list[str]) -> Column:
    """The first prefix that a name starts with, or else the name up to its first - or _."""
    out = F.lit(None).cast("string")
    for p in reversed(prefixes):
        out = F.when(name.startswith(p), F.lit(p)).otherwise(out)
    return F.coalesce(out, F.regexp_extract(name, r"^[^-_]*", 0))
