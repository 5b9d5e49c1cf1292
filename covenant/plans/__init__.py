"""Compositions of the stages: the batch plan, the named-dataset plan and the job."""
