"""Rules' options, merged over a preset and checked before any job runs; the gate."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

import regex

#: In the order that ties between findings follow.
RULE_IDS = (
    "sentence-length max-comma max-kanji-continuous-len no-exclamation-question-mark no-zero-width-spaces no-invalid-control-character no-nfd no-hankaku-kana "
    "ja-no-mixed-period max-ten no-doubled-joshi no-doubled-conjunctive-particle-ga no-doubled-conjunction no-dropping-the-ra no-double-negative-ja "
    "ja-no-weak-phrase no-mix-dearu-desumasu required-headings forbidden terminology"
).split()
OPTIONAL = ("required-headings", "forbidden", "terminology")
PRESET = {
    "sentence-length": {"max": 100},
    "max-comma": {"max": 3},
    "max-kanji-continuous-len": {"max": 6},
    "ja-no-mixed-period": {"periodMark": "。"},
    "max-ten": {"max": 3},
    "no-doubled-joshi": {"min_interval": 1},
    "no-mix-dearu-desumasu": {"preferInHeader": "", "preferInBody": "ですます", "preferInList": "である", "strict": False},
}
GATES = {"never": "never", "none": "never", "warning": "warning", "warn": "warning", "error": "error"}


class ConfigError(ValueError):
    pass


def matcher(spec: str) -> regex.Pattern | None:
    """A literal, or /pattern/flags (i, m, s count; g and u don't matter); an empty one matches nothing."""
    if not spec:
        return None
    if spec[0] == "/" and (end := spec.rfind("/")) > 0:
        body, flags, got = spec[1:end], spec[end + 1 :], regex.V0
        for f in flags:
            if f not in "imsgu":
                raise ConfigError(f"unknown flag {f} in {spec}")
            got |= {"i": regex.I, "m": regex.M, "s": regex.S}.get(f, 0)
        if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?<?[=!]|\\[1-9])", body):
            raise ConfigError(f"look-around and back-references aren't supported: {spec}")
        try:
            return regex.compile(re.sub(r"(?<!\\)((?:\\\\)*)\$(?!\|?\w*\))", r"\1$", body) if got & regex.M else body.replace("$", r"\Z") if body.endswith("$") and not body.endswith(r"\$") else body, got)
        except regex.error as e:
            raise ConfigError(f"{spec}: {e}") from e
    return regex.compile(regex.escape(spec, special_only=True))


@dataclass
class Config:
    rules: dict[str, object] = field(default_factory=lambda: copy.deepcopy({r: PRESET.get(r, True) for r in RULE_IDS if r not in OPTIONAL}))
    gate: dict[str, object] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        import yaml

        class Loader(yaml.SafeLoader):  # true and false alone are booleans
            pass

        Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
        try:
            return cls.merged(yaml.load(text, Loader) or {})  # noqa: S506
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def merged(cls, own: dict) -> Config:
        """own over the preset: mappings key by key, true keeps the preset, anything else takes its place; the gate is own's alone."""
        if not isinstance(own, dict) or set(own) - {"rules", "gate"}:
            raise ConfigError("a configuration has rules and gate")
        out = cls()
        for name, value in (own.get("rules") or {}).items():
            if name not in RULE_IDS:
                hint = next((r for r in RULE_IDS if str(name) in r or r in str(name)), None)
                raise ConfigError(f"unknown rule {name}" + (f"; is it {hint}?" if hint else ""))
            old = out.rules.get(name)
            if value is True and name in out.rules:
                continue
            out.rules[name] = old | value if isinstance(old, dict) and isinstance(value, dict) else value
        out.gate = own.get("gate") or {}
        return out.checked()

    def checked(self) -> Config:
        if set(self.gate) - {"fail-on", "max-warnings"} or self.gate.get("fail-on", "error") not in GATES:
            raise ConfigError(f"unknown gate {self.gate}")
        for name in RULE_IDS:
            if not self.enabled(name):
                continue
            for key in ("patterns", "skipPatterns"):
                for spec in self.strings(name, key):
                    matcher(spec)
        if self.text("sentence-length", "countBy", "codeunits") not in ("codeunits", "codepoints"):
            raise ConfigError("countBy is codeunits or codepoints")
        for term in self.terms():
            if not isinstance(term.get("preferred"), str):
                raise ConfigError("a term needs preferred")
            for spec in _strings(term.get("avoid")):
                matcher(spec)
        return self

    def enabled(self, name: str) -> bool:
        return self.rules[name] is not False if name in self.rules else name not in OPTIONAL

    def option(self, name: str, key: str) -> object:
        value = self.rules.get(name)
        return value.get(key) if isinstance(value, dict) else None

    def number(self, name: str, key: str, default: int) -> int:
        value = self.option(name, key)
        return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default

    def flag(self, name: str, key: str, default: bool) -> bool:
        value = self.option(name, key)
        return value if isinstance(value, bool) else default

    def text(self, name: str, key: str, default: str) -> str:
        value = self.option(name, key)
        return value if isinstance(value, str) else default

    def strings(self, name: str, key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        return _strings(self.option(name, key)) or default

    def terms(self) -> list[dict]:
        value = self.option("terminology", "terms")
        return [t for t in value if isinstance(t, dict)] if isinstance(value, list) else []

    def severity(self, name: str) -> str:
        return "warning" if self.text(name, "severity", "error") in ("warning", "warn") else "error"

    def fails(self, errors: int, warnings: int, max_warnings: int | None = None) -> bool:
        on = GATES[self.gate.get("fail-on", "error")]
        most = max_warnings if max_warnings is not None else self.gate.get("max-warnings")
        return (on == "error" and errors > 0) or (on == "warning" and errors + warnings > 0) or (isinstance(most, int) and warnings > most)


def _strings(value: object) -> tuple[str, ...]:
    return tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else ()
