"""Contract-driven table conformance on Spark."""

from covenant.contract import Contract, ContractError
from covenant.plans.batch import Outcome, apply_contract, split

__all__ = ["Contract", "ContractError", "Outcome", "apply_contract", "split"]
