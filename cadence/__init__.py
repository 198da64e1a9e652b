"""cadence: delivery analytics (velocity, scope creep, cycle time, completion,
backlog readiness, point distribution, health, time tracking) on Spark."""

__version__ = "0.1.0"
