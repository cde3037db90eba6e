"""tabulant: panel & catalog analytics as PySpark DataFrame operators."""

from .session import build_session, cut_lineage, ensure_checkpoint_dir

__all__ = ["build_session", "cut_lineage", "ensure_checkpoint_dir"]
