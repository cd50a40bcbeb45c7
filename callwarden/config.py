"""Switches of an audit run, passed explicitly to the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from callwarden import vocab


@dataclass(frozen=True)
class AuditConfig:
    """One audit run.

    ``catalog`` holds (platform, data_type, token) rows. ``audit_key`` must be secret:
    whoever knows it can predict which declarations are sampled. ``guard`` is a trained type guard
    (``learn.train_guard`` or ``bayes.load_model``); without one no call is stopped by it.
    A call longer than ``max_text_chars`` goes to review unread.
    """

    scope_contract: bool = True
    strict_none: bool = False
    indirect_autopass: bool = False
    audit_key: str | None = None
    audit_permille: int = 50
    allow_relax: bool = False
    auto_lambda: float | None = None
    lambda_auto: float | None = None
    lambda_by_tier: tuple = ()
    certified: bool = False
    salts: int = 16
    max_text_chars: int = vocab.MAX_TEXT_CHARS
    guard: object = field(default=None, compare=False)
    catalog: tuple = field(default_factory=lambda: tuple(vocab.catalog_rows()))

    @property
    def sampling_rate(self) -> float:
        """Share of declaration shapes drawn for audit; may only be raised above 50 per mille."""
        permille = self.audit_permille
        if permille < 50 and not self.allow_relax:
            permille = 50
        return min(max(permille, 0) / 1000.0, 1.0) if self.audit_key else 0.0

    def resolve_lambda(self, tier: str | None) -> tuple[float, str]:
        """Wanted threshold and where it comes from: override, tier, global, default."""
        by_tier = dict(self.lambda_by_tier)
        if self.auto_lambda is not None:
            return self.auto_lambda, "override"
        if tier in by_tier:
            return by_tier[tier], "tier"
        if self.lambda_auto is not None:
            return self.lambda_auto, "global"
        return vocab.DEFAULT_LAMBDA, "default"

    def effective_lambda(self, tier: str | None) -> float:
        """Threshold in force; indirect tiers and uncertified settings have floors."""
        wanted, source = self.resolve_lambda(tier)
        floor = vocab.INDIRECT_FLOOR if tier in vocab.INDIRECT_TIERS else wanted
        relaxed = self.allow_relax if source == "override" else self.certified
        return max(wanted, floor, wanted if relaxed else vocab.DEFAULT_LAMBDA)
