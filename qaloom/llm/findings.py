"""Labelled findings for the secret scan: formats that public documentation describes, in the contexts they occur in.

The tables label no secrets. Each family is a format of secrets or of what is taken for one, with lead-ins of its own;
none is made from the feature lists of the scan. The words around a finding are the corpus's own.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable, Sequence

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
HEX, MIXED = DIGITS + "abcdef", UPPER + LOWER + DIGITS
Finding = tuple[str, int, int, bool]

# How configuration files, shells, code and headers assign a value, {n} for the name and {v} for the value.
ASSIGNED = ['{n} = "{v}"', "{n}: {v}\n", "{n}={v}\n", "export {n}='{v}'", '"{n}": "{v}",', "{n} => '{v}'", "const {n} = `{v}`;", "{n}: '{v}'", "--{n}={v} ", "<{n}>{v}</{n}>"]
SECRET_NAMES = [
    "AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "GITHUB_TOKEN", "SLACK_BOT_TOKEN", "STRIPE_SECRET_KEY", "DATABASE_PASSWORD", "JWT_SECRET", "clientSecret",
    "client_secret", "private_key", "apiKey", "api_key", "X-Api-Key", "smtp_password", "encryptionKey", "session_secret", "webhook_secret", "authToken", "accessToken",
    "refresh_token", "password", "passwd", "DB_PASSWORD", "mysql_pwd", "token", "secret", "secretKey", "credentials", "bearer", "auth",
]
PLAIN_NAMES = [
    "commit", "revision", "sha256", "checksum", "integrity", "etag", "uuid", "build_id", "version", "request_id", "trace", "md5", "image", "src", "href", "class",
    "package", "title", "name", "path", "file", "order", "tracking", "isbn", "value", "label", "user", "host", "region", "message", "digest", "guid", "parent", "tree",
]
PLACEHOLDERS = ["YOUR_API_KEY_HERE", "changeme", "<insert-token>", "${SECRET_KEY}", "xxxxxxxxxxxxxxxxxxxxxxxx", "REPLACE_WITH_YOUR_TOKEN", "null", "none", "required", "********", "os.environ['TOKEN']", "getenv('PASSWORD')"]


class Maker:
    def __init__(self, words: Sequence[str], seed: int):
        self.rng, self.words = random.Random(seed), list(words) or ["lorem", "ipsum", "dolor"]

    def of(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(self.rng.randint(low, high or low)))

    def some(self, low: int, high: int) -> list[str]:
        return [self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))]

    def assign(self, names: Sequence[str], value: str) -> tuple[str, str, str]:
        form = self.rng.choice(ASSIGNED).replace("{n}", self.rng.choice(names))
        lead, _, tail = form.partition("{v}")
        return lead, value, tail


def _password(m: Maker) -> str:
    word = m.rng.choice(m.words)
    return m.rng.choice([
        word.title() + m.rng.choice("!@#$%&*?") + m.of(DIGITS, 2, 5), m.of(MIXED + "!@#$%&*", 8, 20), word + m.of(DIGITS, 3, 6), m.of(UPPER + LOWER, 9, 20),
        word.replace("a", "4").replace("e", "3") + m.of("!$#", 1, 2) + m.of(LOWER, 2, 4),
    ])


def _jwt(m: Maker) -> str:
    part = lambda n: base64.urlsafe_b64encode(bytes(m.rng.randrange(256) for _ in range(n))).decode().rstrip("=")
    return f"eyJ{part(24)}.eyJ{part(m.rng.randint(30, 200))}.{part(32)}"


def _pem(m: Maker) -> str:
    kind = m.rng.choice(["RSA ", "EC ", "OPENSSH ", ""])
    body = base64.b64encode(bytes(m.rng.randrange(256) for _ in range(m.rng.randint(100, 1200)))).decode()
    wide = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{wide}\n-----END {kind}PRIVATE KEY-----"


def _url(m: Maker) -> str:
    return "https://" + m.rng.choice(m.words) + m.rng.choice([".com/", ".org/", ".net/"]) + "/".join(m.some(2, 6)) + m.rng.choice(["", ".html", "?id=" + m.of(DIGITS, 3, 9), "/" + m.of(HEX, 8, 40)])


#: name -> (is a secret, maker of (lead-in, value, tail)).
FAMILIES: dict[str, tuple[bool, Callable[[Maker], tuple[str, str, str]]]] = {
    "access key id": (True, lambda m: m.assign(["AWS_ACCESS_KEY_ID", "aws_access_key_id", "access_key"], "AKIA" + m.of(UPPER + "234567", 16))),
    "secret access key": (True, lambda m: m.assign(SECRET_NAMES, m.of(MIXED + "/+", 40))),
    "prefixed token": (True, lambda m: (m.rng.choice(["", "token ", "with "]), m.rng.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "glpat-", "npm_", "AIza"]) + m.of(MIXED, 24, 40), " ")),
    "bot token": (True, lambda m: m.assign(SECRET_NAMES, f"xoxb-{m.of(DIGITS, 11)}-{m.of(DIGITS, 11)}-{m.of(MIXED, 24)}")),
    "hexadecimal key": (True, lambda m: m.assign(SECRET_NAMES, m.of(HEX, m.rng.choice([32, 40, 64])))),
    "web token": (True, lambda m: (m.rng.choice(["Authorization: Bearer ", "jwt=", "token: ", ""]), _jwt(m), " ")),
    "private key": (True, lambda m: (m.rng.choice(["", "key: |\n", 'private_key = "']), _pem(m), "\n")),
    "base64 key": (True, lambda m: m.assign(SECRET_NAMES, base64.b64encode(bytes(m.rng.randrange(256) for _ in range(m.rng.randint(16, 900)))).decode())),
    "password": (True, lambda m: m.assign(["password", "passwd", "DB_PASSWORD", "mysql_pwd", "smtp_password", "DATABASE_PASSWORD"], _password(m))),
    "spoken password": (True, lambda m: ("password is: ", _password(m), " ")),
    "numeric secret": (True, lambda m: m.assign(["secret", "token", "auth", "credentials"], m.of(DIGITS, 6, 30))),
    "letters": (True, lambda m: m.assign(SECRET_NAMES, m.of(UPPER + LOWER, 16, 40))),
    "commit": (False, lambda m: (m.rng.choice(["commit ", "revision ", "fixed in ", "merge of ", "@", "parent: ", "tree "]), m.of(HEX, 40), m.rng.choice([" ", ".", ")"]))),
    "digest": (False, lambda m: m.assign(["sha256", "md5", "checksum", "etag", "digest", "integrity"], m.rng.choice([m.of(HEX, 32), m.of(HEX, 64), "sha384-" + m.of(MIXED + "+/", 64)]))),
    "uuid": (False, lambda m: m.assign(PLAIN_NAMES, "-".join(m.of(HEX, n) for n in (8, 4, 4, 4, 12)))),
    "link": (False, lambda m: (m.rng.choice(["see ", '<a href="', "(", ""]), _url(m), m.rng.choice(['"', ")", " "]))),
    "path": (False, lambda m: (m.rng.choice(["in ", "from ", "file ", '"']), m.rng.choice(["/usr/", "./", "src/", "C:/"]) + "/".join(m.some(2, 6)) + m.rng.choice([".py", ".java", ".png", ".conf", "/"]), " ")),
    "identifier": (False, lambda m: (m.rng.choice(["class ", "def ", "call ", "new "]), m.rng.choice([lambda: "_".join(m.some(3, 6)), lambda: "".join(w.title() for w in m.some(3, 6)) + m.of(DIGITS, 0, 2)])(), m.rng.choice(["(", " ", "."]))),
    "slug": (False, lambda m: (m.rng.choice(["", "/", "tag "]), "-".join(m.some(4, 12)) + m.rng.choice(["", "-" + m.of(DIGITS, 1, 6)]), " ")),
    "long number": (False, lambda m: (m.rng.choice(["number ", "order ", "card ", "", "account "]), m.of(DIGITS, 16, 24), " ")),
    "picture": (False, lambda m: ("url(data:image/png;base64,", base64.b64encode(bytes(m.rng.randrange(256) for _ in range(m.rng.randint(40, 1500)))).decode(), ")")),
    "placeholder": (False, lambda m: m.assign(SECRET_NAMES, m.rng.choice(PLACEHOLDERS))),
    "phrase": (False, lambda m: (m.rng.choice(["the password: ", "a token: ", "key: ", "secret: ", "auth: "]), " ".join(m.some(1, 6)), m.rng.choice([". ", ", ", "\n"]))),
    "title": (False, lambda m: m.assign(["token", "secret", "key", "password"], " ".join(m.some(2, 5)).capitalize())),
    "plain value": (False, lambda m: m.assign(PLAIN_NAMES, m.rng.choice([m.of(HEX, 16, 40), "_".join(m.some(3, 5)), m.of(DIGITS, 16, 20)]))),
    "word": (False, lambda m: (m.rng.choice(["", "the "]), "".join(m.some(3, 6)), " ")),
}


def labelled(candidates: Callable[[str], list[tuple[int, int]]], words: Sequence[str], n: int = 3000, seed: int = 17, families: Sequence[str] | None = None) -> list[Finding]:
    """``n`` findings (text, start, end, is a secret): the candidates that overlap a value, a family after another."""
    m, out, names = Maker(words, seed), [], list(families or FAMILIES)
    for k in range(100 * n):
        if len(out) >= n:
            break
        secret, make = FAMILIES[names[k % len(names)]]
        lead, value, tail = make(m)
        head = " ".join(m.some(0, 8)) + m.rng.choice([" ", " ", "\n"]) + lead
        text = head + value + tail + " " + " ".join(m.some(0, 6))
        out += [(text, a, b, secret) for a, b in candidates(text) if a < len(head) + len(value) and b > len(head)][:1]
    return out
