"""Pipes, their managers and coordinators."""

from millrace.plans.coordinators import CompositeCoordinator, Coordinator, DeltaCoordinator, IcebergCoordinator, MergeCoordinator, ShardingCoordinator
from millrace.plans.manager import PipeManager
from millrace.plans.pipe import Pipe

__all__ = ["CompositeCoordinator", "Coordinator", "DeltaCoordinator", "IcebergCoordinator", "MergeCoordinator", "Pipe", "PipeManager", "ShardingCoordinator"]
