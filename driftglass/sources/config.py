"""Project configuration: a small subset of YAML, read and written without a library."""

from __future__ import annotations


def scalar(word: str):
    word = word.strip()
    if word[:1] == "[" and word[-1:] == "]":
        return [scalar(w) for w in word[1:-1].split(",")] if word[1:-1].strip() else []
    if len(word) > 1 and word[0] in "\"'" and word[0] == word[-1]:
        return word[1:-1]
    known = {"": None, "null": None, "none": None, "~": None, "true": True, "false": False}
    if word.lower() in known:
        return known[word.lower()]
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word


def loads(text: str) -> dict:
    """Nested maps by indentation, key: value scalars, inline lists, comment lines."""
    top: dict = {}
    open_ = [(-1, top)]
    for n, line in enumerate(text.splitlines(), 1):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        key, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"line {n} has no colon: {line!r}")
        depth = len(line) - len(line.lstrip(" "))
        while open_[-1][0] >= depth:
            open_.pop()
        if value.strip():
            open_[-1][1][key.strip()] = scalar(value)
        else:
            open_[-1][1][key.strip()] = inner = {}
            open_.append((depth, inner))
    return top


def dumps(value: dict, depth: int = 0) -> str:
    out = []
    for k, v in value.items():
        if isinstance(v, dict) and v:
            out += [f"{'  ' * depth}{k}:", dumps(v, depth + 1)]
        else:
            out.append(f"{'  ' * depth}{k}: {_word(v)}")
    return "\n".join(out)


def _word(v) -> str:
    if isinstance(v, list):
        return f"[{', '.join(map(_word, v))}]"
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    return f'"{v}"' if isinstance(v, str) and (scalar(v) != v or set(v) & set("[],:#{}")) else str(v)


def embedding_spec(spec: str) -> dict:
    """provider[:model[:dims]] as an embedding section."""
    parts = spec.split(":")
    return {"provider": parts[0], "model": parts[1] if len(parts) > 1 else "hash-v1", "dims": int(parts[2]) if len(parts) > 2 else 256}
