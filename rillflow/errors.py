"""One exception for everything that a caller can put right."""

from __future__ import annotations


class AnalysisError(ValueError):
    """``code`` names the case, ``detail`` says what happened, ``hint`` what to do about it."""

    def __init__(self, code: str, detail: str, hint: str = "", status: int = 422):
        super().__init__(detail)
        self.code, self.detail, self.hint, self.status = code, detail, hint, status

    def envelope(self) -> dict[str, str]:
        return {"status": "error", "code": self.code, "detail": self.detail, "hint": self.hint}
