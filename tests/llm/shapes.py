"""Texts with secrets of publicly documented shapes, and with look-alikes, unlike those that the forest is trained on."""

import random
import string

ALNUM = string.ascii_letters + string.digits
HEX = "0123456789abcdef"
URL = ALNUM + "-_"
B64 = ALNUM + "+/"


def _pick(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def _name(rnd):
    return "".join(rnd.choice("ba de fi ko lu mar ten sol ver gra net pi".split()) for _ in range(rnd.randint(2, 4)))


SECRETS = {
    "cloud secret key": lambda r: ("aws_secret_access_key = {}\n", _pick(r, B64, 40)),
    "cloud key id": lambda r: ("aws_access_key_id: {}\n", "AKIA" + _pick(r, string.ascii_uppercase + "234567", 16)),
    "fine-grained token": lambda r: ("export GH_PAT={}\n", "github_pat_" + _pick(r, ALNUM, 22) + "_" + _pick(r, ALNUM, 59)),
    "chat token": lambda r: ('slack: "{}"', f"xoxb-{_pick(r, string.digits, 12)}-{_pick(r, string.digits, 13)}-{_pick(r, ALNUM, 24)}"),
    "payment key": lambda r: ("stripe.api_key = '{}'", "sk_live_" + _pick(r, ALNUM, 24)),
    "search key": lambda r: ("maps init({}) now", "AIza" + _pick(r, URL, 35)),
    "mail key": lambda r: ("SENDGRID_API_KEY={}\n", f"SG.{_pick(r, URL, 22)}.{_pick(r, URL, 43)}"),
    "web token": lambda r: ("Authorization: Bearer {}\n", f"eyJ{_pick(r, URL, 33)}.eyJ{_pick(r, URL, 60)}.{_pick(r, URL, 43)}"),
    "package token": lambda r: ("//registry/:_authToken={}\n", "npm_" + _pick(r, ALNUM, 36)),
    "account key": lambda r: ("AccountName=logs;AccountKey={};EndpointSuffix=core", _pick(r, B64, 86) + "=="),
    "password in json": lambda r: ('{{"user": "ann", "password": "{}"}}', _pick(r, ALNUM + "!@#%^&*", 14)),
    "password in yaml": lambda r: ("db:\n  password: {}\n", _pick(r, ALNUM + "!@%^*", 12)),
    "phrase": lambda r: ("PASSWD={}\n", _name(r).title() + str(r.randint(10, 9999)) + r.choice("!?#")),
}
CLEAN = {
    "commit": lambda r: ("fixed in {} last week", _pick(r, HEX, 40)),
    "image digest": lambda r: ("FROM base@sha256:{} AS build", _pick(r, HEX, 64)),
    "integrity": lambda r: ('"integrity": "sha512-{}"', _pick(r, B64, 86) + "=="),
    "uuid": lambda r: ("row {} was read", "-".join(_pick(r, HEX, n) for n in (8, 4, 4, 4, 12))),
    "long identifier": lambda r: ("calls {}(x)", "".join(_name(r).title() for _ in range(4))),
    "constant": lambda r: ("see {} in the header", "_".join(_name(r).upper() for _ in range(3))),
    "address": lambda r: ("at https://example.org/{} today", "/".join(_name(r) for _ in range(4))),
    "file": lambda r: ("open /var/lib/{}.log", "/".join(_name(r) for _ in range(3))),
    "number": lambda r: ("order 4{} has shipped", _pick(r, string.digits, 17)),
    "placeholder": lambda r: ("password = {}", r.choice(["<your-password>", "${DB_PASSWORD}", "os.environ['PW']", "********", "getpass()"])),
    "prose": lambda r: ("the token {} is read by the parser", _name(r)),
    "version": lambda r: ("lib-{} is out", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-beta.{r.randint(1, 30)}+build"),
}


def made(n, seed=3):
    """(text, kind, value, is secret): n of each shape."""
    rnd = random.Random(seed)
    out = []
    for is_secret, shapes in ((True, SECRETS), (False, CLEAN)):
        for kind, shape in shapes.items():
            for _ in range(n):
                form, value = shape(rnd)
                before, after = (" ".join(_name(rnd) for _ in range(rnd.randint(3, 8))) for _ in range(2))
                out.append((f"{before} {form.format(value)} {after}", kind, value, is_secret))
    return out
