"""Result tables, shared intermediate storage and the quality report."""

from covenant.sinks.report import report_frame
from covenant.sinks.staging import SharedStage, shared_folder
from covenant.sinks.writers import is_table_target, write_outcome

__all__ = ["SharedStage", "is_table_target", "report_frame", "shared_folder", "write_outcome"]
