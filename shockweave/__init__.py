"""Flow-network stress testing as Spark DataFrame jobs.

Every table is keyed: nodes by ``node``, edges by ``(i, j)``, and everything a
shock touches additionally by ``scenario_id``, so that one job carries any
number of scenarios.
"""
