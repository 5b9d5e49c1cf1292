"""The labelled table for personal data: lines with marked spans, from hand-written frames and drawn values."""

from __future__ import annotations

import random

#: How many labelled lines the field is fitted to.
TRAINING_LINES = 700
_SYLLABLES = "an be cor da el fi gra hu in jo ka lo mé nu or pa que ri sün ta ur ve wo xi yo zañ th st er".split()

#: Frames; a name in braces is a value of that kind, W a stretch of words, N something that is no personal data.
FRAMES = [
    "W {email} W", "W: {email}", "Contact {email}, W.", "mail to {email} or {phone}", "<{email}>", "W ({email}) W", "{email}",
    "W {ip} W", "host {ip} W", "from {ip}: W", "W {ip}.", "{ip}", "W [{ip}] W", "W, {ip}, W",
    "W {card} W", "card {card}", "W: {card}.", "{card} W", "paid with {card}, W", "W {card}",
    "W {phone} W", "call {phone}", "Tel: {phone}", "W, {phone}.", "{phone}", "phone {phone} or {email}", "W {phone} W {ip} W",
    'token = "{secret}"', "W api_key={secret} W", "secret: {secret}", 'W token = "{secret}" W', "password = '{secret}'", "W {secret} W",
    "IBAN {iban}", "W account {iban} W", "{iban}", "pay to {iban}, W", "SSN {national_id}", "W number {national_id} W", "id: {national_id}.",
    "W", "W", "W", "W", "W", "W", "W", "W", "W", "W", "W N W", "W N W", "N", "W, N.", "W (N) W", "N W", "N N N W", "W N, W N.", "W N N W",
    "W {card} {email} W", "W {email} {secret} W {phone}", "W {ip} N W", "N W {card} N W",
]


class Draw(random.Random):
    def word(self) -> str:
        return "".join(self.choices(_SYLLABLES, k=self.choice((1, 1, 2, 2, 3, 4, 5))))

    def digits(self, n: int) -> str:
        return "".join(self.choices("0123456789", k=n))

    def words(self) -> str:
        made = [self.word() for _ in range(self.choice((1, 2, 3, 5, 8, 14)))]
        style = self.random()
        if style < 0.12:
            made = [w + self.choice(("***", "###", "%%%", "$$$", "&&&", "!!", ".", ",", "?!")) for w in made]
        elif style < 0.2:
            made = [w.upper() + self.choice(("", "!!", ",", ".")) for w in made]
        elif style < 0.25:
            made = [self.choice((w, "|", "|", "-", "&", "(" + w + ")", f'"{w}"', "*", "=", "+")) for w in made]
        elif style < 0.3:
            made = [self.choice((w, f"{w}-{self.word()}", f"{w}'s", f"{w}/{self.word()}", f"{w}:", f"{w}.{self.word()}")) for w in made]
        else:
            made[0] = made[0].capitalize()
            made = [w + self.choice(("", "", "", ",", ".")) for w in made]
        return " ".join(made)

    def harmless(self) -> str:
        n = self.randint
        return self.choice((
            str(n(0, 9)), str(n(10, 999)), str(n(1000, 99999)), f"{n(0, 9)}.{n(0, 9)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
            f"{n(1, 31)}.{n(1, 12)}.{n(1950, 2030)}", f"{n(1950, 2030)}-0{n(1, 9)}-{n(10, 28)}", f"{n(1, 24)}:{n(10, 59)}",
            f"${n(1, 999)}.{n(10, 99)}", f"{n(1, 99)}%", f"{n(1, 9)},{n(100, 999)},{n(100, 999)}", f"#{n(1, 9999)}", f"({n(1, 99)})",
            f"https://www.{self.word()}.org/{self.word()}?p={n(1, 99)}", f"{self.word()}{n(1, 99)}", f"{n(1, 40)}th", f"{self.word()}_{self.word()}",
            f"{self.word()}@", f"@{self.word()}", f"+{n(1, 99)}", f"{self.digits(6)}", f"{self.digits(9)}", f"§{n(1, 99)}", f"{n(1, 9)}/{n(1, 9)}",
            self.digits(n(20, 30)), self.digits(12), f"{self.word().upper()}-{n(100, 9999)}", self.word() * 6, "x" * n(20, 45), "=" * n(4, 60),
            f"arXiv:{self.digits(4)}.{self.digits(5)}", f"{self.word()}.{self.word()}.{self.word()}", f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}",
        ))

    def value(self, kind: str) -> str:
        n = self.randint
        if kind == "email":
            local = self.choice((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{n(1, 99)}", f"{self.word()}.{n(10, 99)}", f"{self.word()}_{self.word()}"))
            host = self.choice((self.word(), f"mail{n(1, 9)}.{self.word()}", f"{self.word()}-{self.word()}"))
            return f"{local}@{host}.{self.choice(('com', 'org', 'net', 'de', 'co.uk', 'example.com'))}".encode("ascii", "ignore").decode()
        if kind == "ip":
            return ".".join(str(n(0, 255)) for _ in range(4))
        if kind == "card":
            digits = self.choice("3456") + self.digits(15)
            return self.choice((digits, digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))))
        if kind == "phone":
            return self.choice((
                f"+{n(1, 99)} ({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", f"+{n(1, 99)} {self.digits(3)} {self.digits(7)}",
                f"+{n(1, 99)}-{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f"+{n(1, 99)}{self.digits(9)}", f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}",
            ))
        if kind == "secret":
            size = self.choice((32, 36, 40, 40, 40, 48, 64))
            letters = self.choice(("0123456789abcdef", "0123456789abcdef", "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQR"))
            return "".join(self.choices(letters, k=size))
        if kind == "iban":
            code = self.choice(("DE", "FR", "ES", "GB", "IT", "NL")) + self.digits(2)
            body = self.digits(self.choice((18, 20, 23)))
            return self.choice((code + body, code + " " + " ".join(body[i : i + 4] for i in range(0, len(body), 4))))
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"


def _filled(draw: Draw, frame: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, at = "", [], 0
    while at < len(frame):
        if frame[at] == "{":
            stop = frame.index("}", at)
            kind = frame[at + 1 : stop]
            value = draw.value(kind)
            spans.append((kind, len(text), len(text) + len(value)))
            text, at = text + value, stop + 1
        elif frame[at] in "WN" and not frame[at + 1 : at + 2].isalpha() and not frame[at - 1 : at].isalpha():
            text, at = text + (draw.words() if frame[at] == "W" else draw.harmless()), at + 1
        else:
            text, at = text + frame[at], at + 1
    return text, spans


def labelled_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    draw = Draw(seed)
    return [_filled(draw, FRAMES[i % len(FRAMES)]) for i in range(n)]
