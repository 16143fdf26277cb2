"""Inspected examples of prose, lists, tables and junk.

The texts are invented; each group is one shape that was seen when looking at
documents. They start the components of the mixture and name them afterwards.
"""

from __future__ import annotations

import base64
import random
from urllib.parse import quote

_SENTENCES = {
    "en": ["The council of {p} approved the plan for the new bridge after a long debate.", "Engineers at {p} said that the pumps had been repaired before the storm.",
           "Although costs had risen, the ministry extended the contract with the two carriers.", "Residents near {p} were told to boil their water for {n} days.",
           "In a vote of {n} to 12, the assembly rejected a ban on fires in the hills.", "A spokesperson for the port declined to name a date for the inquiry."],
    "de": ["Der Rat von {p} billigte den Plan für die neue Brücke nach einer langen Nacht.", "Die Ingenieure in {p} prüften die Pumpen vor dem Winter.",
           "Obwohl die Kosten gestiegen waren, verlängerte das Ministerium den Vertrag mit den Bahnen.", "Die Anwohner bei {p} sollten das Wasser {n} Tage lang abkochen."],
    "fr": ["Le conseil de {p} a approuvé le plan du nouveau pont après un long débat.", "Les ingénieurs de {p} ont réparé les pompes avant la saison des pluies."],
    "es": ["El consejo de {p} aprobó el plan del nuevo puente tras un largo debate.", "Los ingenieros de {p} repararon las bombas antes de la temporada de lluvias."],
    "zh": ["{z}议会批准了新大桥的方案，会谈一直持续到深夜。", "{z}的工程师检查了水泵，虽然成本已经上升。", "主管部门延长了与两家公司的合同，没有说明具体日期。", "{z}附近的居民被告知要把水烧开{n}天。"],
}
_PLACES = ["Mandel Rova", "Kirsu Tale", "Ovido Pell", "Tarno Besk", "Lumeri Kost", "Sabel Finto", "Gorvan Ude", "Pelika Sorn", "Rudo Marse", "Velta Kimo", "Nisko Darve", "Hamo Tildi"]
_ZH = ["马德·罗瓦", "基苏·塔莱", "奥维·佩尔", "塔诺·贝斯", "卢梅·科斯", "萨贝·芬托", "戈万·乌德", "佩利·索恩", "鲁多·马塞", "维塔·基莫"]
_HEADS = {"en": ["Ferry to {p} sails again after {n} days", "Fire near {p} covers {n} km²", "{p} opens a new hospital", "Live: storm over {p}"], "de": ["Fähre nach {p} fährt nach {n} Tagen", "Brand bei {p} erfasst {n} km²", "{p} öffnet ein Krankenhaus"],
          "zh": ["{z}停电{n}小时", "{z}山火蔓延{n}平方公里", "{z}新医院动工", "{z}粮价走高"]}
_ENTRIES = {"en": ["Warehouse {p}, {n} boxes", "Bus {n} via {p}, closed", "{p} pharmacy, open", "{p}", "{p}: {n} homes without power"], "de": ["Depot {p}, {n} Kisten", "Bus {n} über {p}, gesperrt", "{p}"], "zh": ["{z}", "{z}仓库，{n}箱", "{z}：{n}户停电"]}
_MENU = {"en": ["Home", "World", "Markets", "Weather", "Video", "Sign in", "Opinion", "Archive", "Contact", "Imprint", "Help", "Careers"], "zh": ["首页", "国际", "财经", "天气", "视频", "登录", "关于我们", "招聘"], "de": ["Start", "Welt", "Wetter", "Kontakt", "Impressum", "Hilfe"]}


def examples() -> list[tuple[str, str, str, str]]:
    """(kind, group, lang, text); the same on every call."""
    rng = random.Random(11)
    out: list[tuple[str, str, str, str]] = []

    def fill(t: str) -> str:
        return t.format(p=rng.choice(_PLACES), z=rng.choice(_ZH), n=rng.randint(2, 990))

    def prose(lang: str, n: int, per: int = 3) -> list[str]:
        s = [fill(rng.choice(_SENTENCES[lang])) for _ in range(n)]
        return [("" if lang == "zh" else " ").join(s[i : i + per]) for i in range(0, n, per)]

    def wrapped(text: str, width: int = 68) -> str:
        lines, now = [], ""
        for w in text.split(" "):
            if len(now) + len(w) + 1 > width:
                lines.append(now)
                now = w
            else:
                now = f"{now} {w}".strip()
        return "\n".join([*lines, now])

    def cells(lang: str) -> list[str]:
        return [rng.choice(_ZH if lang == "zh" else _PLACES), f"{rng.uniform(0, 90):.2f}", f"{rng.uniform(-9, 9):+.1f}", f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"]

    for lang in ("en", "en", "en", "de", "de", "fr", "es"):
        for n in (4, 9, 18):
            out.append(("prose", "prose", lang, "\n".join(prose(lang, n))))
            out.append(("prose", "prose headline", lang, "\n".join([fill(_HEADS["de" if lang == "de" else "en"][0]), *prose(lang, n)])))
            out.append(("prose", "prose wrapped", lang, "\n\n".join(wrapped(p) for p in prose(lang, n))))
            out.append(("prose", "prose short list", lang, "\n".join([*prose(lang, n), *["- " + fill(rng.choice(_ENTRIES["de" if lang == "de" else "en"])) for _ in range(max(2, n // 4))], *prose(lang, 6)])))
    for n in (4, 9, 18):
        for _ in range(2):
            out.append(("prose", "prose zh", "zh", "\n".join(prose("zh", n))))
            out.append(("prose", "prose zh", "zh", "\n".join([fill(_HEADS["zh"][0]), *prose("zh", n)])))
            out.append(("prose", "prose zh short list", "zh", "\n".join([*prose("zh", n), *["* " + fill(rng.choice(_ENTRIES["zh"])) for _ in range(max(2, n // 4))], *prose("zh", 5)])))
    for lang in ("en", "en", "de", "zh"):
        z = "zh" if lang == "zh" else ""
        for n in (10, 28):
            entries = [fill(rng.choice(_ENTRIES[lang])) for _ in range(n)]
            heads = [fill(rng.choice(_HEADS[lang])) for _ in range(n)]
            names = [rng.choice(_ZH if z else _PLACES) for _ in range(2 * n)]
            menu = [rng.choice(_MENU[lang]) for _ in range(2 * n)]
            intro = prose(lang, 1)
            out += [
                ("list", f"list bullets {z}", lang, "\n".join("- " + e for e in entries)), ("list", f"list bullets {z}", lang, "\n".join(f"{i + 1}. {e}" for i, e in enumerate(entries))),
                ("list", f"list entries {z}", lang, "\n".join(entries)), ("list", f"list entries {z}", lang, "\n".join(heads)), ("list", f"list entries {z}", lang, "\n".join(intro + entries)),
                ("list", f"list bullets {z}", lang, "\n".join(intro + ["* " + e for e in entries])),
                ("list", f"list names {z}", lang, ("，" if z else ", ").join(names)), ("list", f"list names {z}", lang, "\n".join(intro + [("，" if z else ", ").join(names)])),
                ("list", f"list menu {z}", lang, " · ".join(menu)), ("list", f"list menu {z}", lang, " | ".join(menu)), ("list", f"list menu {z}", lang, "\n".join(menu)), ("list", f"list menu {z}", lang, "\n".join(intro + [" / ".join(menu)])),
            ]
            head = fill(_HEADS[lang][0])
            rows = [cells(lang) for _ in range(n)]
            out += [
                ("table", f"table pipes {z}", lang, "\n".join("| " + " | ".join(r) + " |" for r in rows)), ("table", f"table pipes {z}", lang, "\n".join([head] + ["| " + " | ".join(r) + " |" for r in rows])),
                ("table", f"table columns {z}", lang, "\n".join("\t".join(r) for r in rows)), ("table", f"table columns {z}", lang, "\n".join(f"{r[0]:<24}{r[1]:>8}{r[2]:>10}{r[3]:>10}" for r in rows)),
                ("table", f"table commas {z}", lang, "\n".join((";" if i % 2 else ",").join(r) for i, r in enumerate(rows))), ("table", f"table commas {z}", lang, "\n".join([head] + [";".join(r) for r in rows])),
                ("table", f"table scores {z}", lang, "\n".join(f"{r[0]}  {rng.randint(0, 6)} : {rng.randint(0, 6)}  {rng.choice(_ZH if z else _PLACES)}" for r in rows)),
            ]
    for n in (6, 14):
        text = "\n".join(prose("zh", n))
        out += [("junk", "junk mojibake", "zh", text.encode().decode("cp1252", errors="replace")), ("junk", "junk percent", "zh", quote(text)), ("junk", "junk percent", "en", "".join(f"%{b:02X}" for b in prose("en", n)[0].encode()))]
        out += [("junk", "junk mojibake latin", "de", " ".join(prose("de", n)).encode().decode("latin-1")), ("junk", "junk mojibake latin", "en", "\n".join(prose("en", n)).replace("o", "�").replace("i", "�"))]
        out += [("junk", "junk letters", "en", " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 13))) for _ in range(8 * n)))]
        raw = bytes(rng.randrange(256) for _ in range(60 * n))
        out += [("junk", "junk blob", "en", base64.b64encode(raw).decode()), ("junk", "junk blob", "de", raw.hex()), ("junk", "junk blob", "zh", base64.b64encode(raw).decode())]
        out += [("junk", "junk logs", lang, "\n".join(f"2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 0{rng.randint(0, 9)}:1{rng.randint(0, 9)}:22 ERROR [worker-{rng.randint(0, 8)}] load.py:{rng.randint(9, 999)} status={rng.choice([403, 500])} retry={rng.randint(0, 3)} body={{\"id\":{rng.randint(10**5, 10**6)}}}" for _ in range(n))) for lang in ("en", "zh")]
        out += [("junk", "junk code", lang, " ".join(rng.choice(["null", "undefined", "${body}", "{{title}}", "</div>", "&nbsp;", "NaN", "function(){", ");}", "var _0x1f=", "[object Object]", "%E2", "&#160;"]) for _ in range(9 * n))) for lang in ("en", "de")]
        out += [("junk", "junk repetition", "en", sep.join([w] * 10 * n)) for w, sep in (("breaking", " "), ("update", ", "), ("News", "\n"), ("click here", " "), ("alert", "! "), ("Mandel Rova now", "! "), ("more", ". "))]
        out += [("junk", "junk repetition zh", "zh", sep.join([w] * 10 * n)) for w, sep in (("快讯", " "), ("快讯", ", "), ("点击", "，"), ("快讯", "! "), ("直播", "！"))]
        out += [("junk", "junk repetition", "en", "\n".join([fill(_SENTENCES["en"][0])] * 2 * n))]
        out += [("junk", "junk symbols", "en", "\n".join("".join(rng.choice("<>|_~*:=-./#") for _ in range(3)) * rng.randint(6, 15) for _ in range(n)))]
        out += [("junk", "junk symbols", "zh", " ".join("".join(rng.choice("!@#$%^&*()_+=?<>~") for _ in range(rng.randint(2, 12))) for _ in range(6 * n)))]
    return out
