"""Reports and narratives rendered on the driver from small collected results."""

from __future__ import annotations

import html
import json
import re

FATES = ("boundary-shifted", "dropped", "intact", "merged", "split")
STAGES = ("dense", "sparse", "fused", "rerank", "index", "ann")
_NAMES = {"chunk": ("chunker", "chunk"), "embed": ("embedding", "embed"), "retrieve": ("retrieval", "retrieve"), "corpus": ("corpus",), "parse": ("parser",), "rerank": ("reranker",)}
_FATE_TEXT = {
    "split": "The chunker now cuts the target into {n} pieces, each of which scores lower.",
    "merged": "The chunker now folds the target into a larger chunk (overlap {score:.2f}), which weakens its match.",
    "boundary-shifted": "The target is boundary-shifted: the nearest new chunk holds only part of it (overlap {score:.2f}).",
    "dropped": "The target is dropped: no new chunk covers it (overlap {score:.2f}).",
}
_CAUSE_TEXT = {
    "chunk": "Going back to the old chunker alone restores {rank} (verified by {arm}).",
    "retrieve": "The retrieval weights moved the target down; going back alone restores {rank} (verified by {arm}).",
    "embed": "The embedding changed and no mechanism is claimed; going back alone restores {rank} (verified by {arm}).",
    "corpus": "New documents of the corpus outrank the target; going back alone restores {rank} (verified by {arm}).",
}


def narrative(funnel: dict, fate: dict | None, causes: list[dict]) -> str:
    """Sentences for one regressed query, from evidence only."""
    out = []
    if fate and fate["fate"] in _FATE_TEXT:
        out.append(_FATE_TEXT[fate["fate"]].format(n=len(fate["descendants"]), score=fate["score"]))
    verified = sorted((c for c in causes if c["status"] == "verified"), key=lambda c: (c["factor"], c["arm_id"]))
    for c in verified:
        rank = f"rank {c['recovered_rank']}" if c["recovered_rank"] is not None else "the target"
        out.append(_CAUSE_TEXT.get(c["factor"], f"Going back to the old {c['factor']} alone restores {{rank}} (verified by {{arm}}).").format(rank=rank, arm=c["arm_id"]))
    if not verified:
        moves = ", ".join(f"{s} {_rank(funnel.get(s + '_before'))} to {_rank(funnel.get(s + '_after'))}" for s in ("dense", "sparse", "fused"))
        out.append(f"Unverified: no single revert brings the target back; ranks went {moves}.")
    if funnel.get("ann"):
        out.append("The served index disagrees with exact search (ann).")
    out += [f"Unverified: {c['factor']} may be involved, as the {funnel.get('stage')} stage lost the target." for c in causes if c["status"] == "hypothesis"]
    return " ".join(out)


def _rank(r: int | None) -> str:
    return "absent" if r is None else str(r)


def _has(text: str, word: str) -> bool:
    return re.search(rf"(?<![\w-]){re.escape(word)}(?![\w-])", text, re.IGNORECASE) is not None


def audit(text: str, funnel: dict, fate: dict | None, causes: list[dict]) -> list[str]:
    """Claims in text that the evidence does not carry; empty for an honest narrative."""
    arms = {c["arm_id"] for c in causes if c["status"] == "verified"}
    bad = [f"arm {a}" for a in re.findall(r"\barm_[0-9a-f]+\b", text) if a not in arms]
    bad += [f"fate {f}" for f in FATES if _has(text, f) and (fate is None or fate["fate"] != f)]
    carried = {funnel.get("stage")} | ({"ann"} if funnel.get("ann") else set()) | {s for s in ("dense", "sparse", "fused") if f"{s}_before" in funnel or f"{s}_after" in funnel}
    bad += [f"stage {s}" for s in STAGES if _has(text, s) and s not in carried]
    known = {c["factor"] for c in causes} | ({"chunk"} if fate else set())
    return bad + [f"factor {w}" for f, words in _NAMES.items() if f not in known for w in words if _has(text, w)]


def diff_markdown(diff, verdict=None, calibrated: bool = False, causes: list[dict] | None = None, metric: str = "recall@5") -> str:
    """A pull-request summary."""
    rows = sorted(diff.queries.collect(), key=lambda r: str(r.query_id))
    count = lambda c, s=None: sum(r["class"] == c and s in (None, r.stability) for r in rows)
    out = ["## Retrieval diff", ""]
    if verdict is not None:
        out += [f"**Gate ({verdict.mode}): {'passed' if verdict.passed else 'failed'}**", *(f"- {x}" for x in verdict.reasons), ""]
    out += [f"Calibration: {'present' if calibrated else 'missing'}", ""]
    out += [f"{count('regressed', 'stable')} regressed, {count('improved')} improved, {count('changed-top-k')} with another top, {sum(r.stability == 'unstable' for r in rows)} near ties left out", ""]
    ci = verdict.details.get("ci") if verdict is not None else None
    out += ["| metric | change (all) | interval (stable) |", "|-|-|-|"]
    out += [f"| {m} | {d:+.4f} | {f'{ci[0]:+.4f} to {ci[1]:+.4f}' if ci and m == metric else ''} |" for m, d in sorted(diff.deltas.items())]
    if verified := [c for c in causes or [] if c["status"] == "verified"]:
        out += ["", "**Verified causes**", *(f"- {c['query_id']}: {c['factor']}, rank {_rank(c['recovered_rank'])} ({c['arm_id']})" for c in sorted(verified, key=lambda c: (str(c["query_id"]), c["factor"]))[:5])]
    out += ["", "<details><summary>Configuration</summary>", "", *(f"- {k}: {json.dumps(v, sort_keys=True)}" for k, v in sorted(diff.config.items())), "", "</details>"]
    out += ["", "<details><summary>Regressed</summary>", "", "| query | change | stability |", "|-|-|-|", *(f"| {r.query_id} | {r.delta:+.4f} | {r.stability} |" for r in rows if r["class"] == "regressed"), "", "</details>"]
    return "\n".join(out)


def page(title: str, markdown: str) -> str:
    """A self-contained page around escaped text."""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><pre>{html.escape(markdown)}</pre></body></html>"


def comparison(diff, old: str, new: str, usd: float = 0.0, metric: str = "recall@5") -> str:
    """What a comparison of two settings says: changes, counts, cost and which to keep."""
    change = diff.deltas.get(metric, 0.0)
    keep = new if change > 0 else old if change < 0 else "either"
    rows = "\n".join(f"| {m} | {d:+.4f} |" for m, d in sorted(diff.deltas.items()))
    counts = ", ".join(f"{n} {k}" for k, n in sorted(diff.counts().items()))
    return f"## {old} against {new}\n\n| metric | change |\n|-|-|\n{rows}\n\nQueries: {counts}\n\nCost: ${usd:.4f}\n\n**Recommendation: {keep}** ({metric} {change:+.4f})"


def query_page(diff, causes: list[dict] | None = None) -> str:
    """A self-contained page with a row per query."""
    by: dict = {}
    for c in causes or []:
        by.setdefault(c["query_id"], []).append(f"{c['factor']} ({c['status']})")
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    rows = sorted(diff.queries.collect(), key=lambda r: (r["class"] != "regressed", str(r.query_id)))
    body = "".join("<tr>" + "".join(map(cell, (r.query_id, r["class"], r.stability, f"{r.before:.4f}", f"{r.after:.4f}", f"{r.delta:+.4f}", ", ".join(by.get(r.query_id, []))))) + "</tr>" for r in rows)
    deltas = "".join(f"<tr>{cell(m)}{cell(f'{d:+.4f}')}</tr>" for m, d in sorted(diff.deltas.items()))
    head = "".join(f"<th>{h}</th>" for h in ("query", "class", "stability", "before", "after", "change", "causes"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(diff.diff_id)}</title></head><body><h1>{html.escape(diff.diff_id)}</h1><table><tr><th>metric</th><th>change</th></tr>{deltas}</table><table><tr>{head}</tr>{body}</table></body></html>"


def table(rows: list[tuple], header: tuple) -> str:
    """Aligned plain text."""
    cells = [tuple(map(str, header)), *(tuple(f"{c:.4f}" if isinstance(c, float) else str(c) for c in r) for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(header))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)


def diff_json(diff, verdict=None, causes: list[dict] | None = None) -> str:
    rows = [r.asDict() for r in sorted(diff.queries.collect(), key=lambda r: str(r.query_id))]
    return json.dumps({"diff_id": diff.diff_id, "config": diff.config, "deltas": diff.deltas, "queries": rows, "gate": verdict and verdict.to_dict(), "causes": causes or []}, sort_keys=True, indent=2, default=str)
