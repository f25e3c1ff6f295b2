"""A pull request's summary comment: written once, then brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from driftglass.functions.providers import post_json

MARK = "<!-- driftglass -->"


def upsert_comment(repository: str, number: int, body: str, token: str, api: str = "https://api.github.com", send: Callable = post_json) -> str:
    """The comment's id; the comment that carries MARK is changed, or a new one made."""
    headers = {"Authorization": f"Bearer {token}", "Accept": "application/vnd.github+json"}
    text = {"body": f"{MARK}\n{body}"}
    page = 1
    while found := send(f"{api}/repos/{repository}/issues/{number}/comments?per_page=100&page={page}", {}, headers, method="GET"):
        for c in found:
            if MARK in (c.get("body") or ""):
                send(f"{api}/repos/{repository}/issues/comments/{c['id']}", text, headers, method="PATCH")
                return str(c["id"])
        page += 1
    return str(send(f"{api}/repos/{repository}/issues/{number}/comments", text, headers)["id"])
