"""A small table of labelled sentences for the recogniser of personal data.

Built by rule from a seed: forms of the four kinds and of numbers that are none of them,
set into short contexts.  ``#`` stands for a digit.  Labels are offsets into the text.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "text string, spans array<struct<kind: string, start: int, end: int>>"

# Forms of each kind, {card} stands for a valid card number.
FORMS = {
    "email": (
        "anna.b##@mail#.example.com", "karl@host.example.org", "x_y-z@sub.domain.net", "info [at] host [dot] org",
        "lea## (at) mail (dot) net", "max at mail dot com", "j.doe AT example DOT org", "paul @ mail.example.com",
        "jürgen@müller.de", "zoë.b@österreich.at", "mia##@host . org", "tom{at}web{dot}de", "eva <at> post <dot> fr",
    ),
    "ip": (
        "{byte}.{byte}.{byte}.{byte}", "{byte}[.]{byte}[.]{byte}[.]{byte}", "{byte} . {byte} . {byte} . {byte}",
        "{byte}(.){byte}(.){byte}(.){byte}", "2001:db8::{hex}", "fe80::{hex}:{hex}:{hex}:{hex}",
        "2001:{hex}:{hex}:{hex}:{hex}:{hex}:{hex}:{hex}",
    ),
    "card": ("{card}", "{card4-}", "{card4 }", "{card4.}", "{card4/}", "{card4_}", "{card4 - }"),
    "phone": (
        "+# (###) ###-####", "+## ## ### ####", "+##-###-#######", "(###) ###-####", "###-###-####", "(0##) ### ####",
        "0## / ### ## ##", "0### ######", "00## ### #######", "0#.##.##.##.##", "###.###.####", "+##/##/#######", "(0##)#######",
    ),
    "": (
        "####", "##", "#####", "########", "###########", "################", "##.##", "#,###.##", "##%", "$##.##", "##:##",
        "####-##-##", "##/##/####", "##.##.####", "v#.#.#", "#.#.##", "3##.4##.5##.##", "{hex}{hex}{hex}{hex}", "\"{hex}{hex}{hex}{hex}{hex}{hex}\"",
        "key-{hex}{hex}", "id_######", "ISBN 978-#-##-######-#", "no. ###", "p. ##-##", "## x ##", "#e-##", "[##]", "(##)", "#.", "{hex}-{hex}-{hex}",
        "@user##", "@home", "user@host", "## km", "A#", "{bad card}", "{bad card4 }", "{bad card4-}", "### ### ###", "##-##-##", "##.", "at ##", "## at ##:##",
        "###,###,###", "##°##'##", "| ## | ### |", "##!!", "## ## ## ##", "token = \"{hex}{hex}{hex}\"",
    ),
}
BEFORE = {
    "email": ("mail", "write to", "e-mail:", "Kontakt:", "correo", "courriel :", "and then the", "die und"),
    "ip": ("host", "from", "IP", "Adresse", "server at", "desde", "the of", "der"),
    "card": ("card", "Karte Nr.", "tarjeta:", "carte", "paid with", "the in"),
    "phone": ("call", "Tel.", "tel:", "phone", "fax", "teléfono", "ring", "mobile:", "Telefon"),
    "": ("the", "in", "und der", "see", "order", "number", "Seite", "de la", "with", "version", "on", "call the", "mail of", "card of", "host of"),
}
AFTER = ("", ".", " and then", ", please.", " or the other", "!", "; thanks", "\nund die", " esta tarde", ") oder", " the tion.", " | next")
COPIES = 6


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum((2 * int(d)) % 10 + int(d) // 5 for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _card(rnd: random.Random, good: bool) -> str:
    body = rnd.choice("3456") + "".join(rnd.choice("0123456789") for _ in range(14))
    check = next(d for d in "0123456789" if luhn(body + d))
    return body + (check if good else str((int(check) + rnd.randint(1, 9)) % 10))


def fill(form: str, rnd: random.Random) -> str:
    """A form with its place holders filled in."""
    while "{" in form:
        begin = form.index("{")
        end = form.index("}", begin)
        name = form[begin + 1:end]
        if name == "byte":
            value = str(rnd.randint(0, 255))
        elif name == "hex":
            value = f"{rnd.randint(1, 0xFFFF):x}"
        elif "card" in name:
            value = _card(rnd, not name.startswith("bad"))
            if "4" in name:
                value = name[name.index("4") + 1:].join(value[i:i + 4] for i in range(0, 16, 4))
        else:  # part of the form itself
            value = f"\x01{name}\x02"
        form = form[:begin] + value + form[end + 1:]
    form = form.replace("\x01", "{").replace("\x02", "}")
    return "".join(rnd.choice("0123456789") if c == "#" else c for c in form)


def sentences(seed: int = 13, copies: int = COPIES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rnd, out = random.Random(seed), []
    for kind, forms in FORMS.items():
        for form in forms:
            for _ in range(copies):
                before, value, after = rnd.choice(BEFORE[kind] + BEFORE[""]), fill(form, rnd), rnd.choice(AFTER)
                start = len(before) + 1
                spans = [(kind, start, start + len(value))] if kind else []
                out.append((f"{before} {value}{after}", spans))
    return out


def example_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sentences(), SCHEMA)
