"""Contract-event analytics on Spark DataFrames.

The two jobs most callers need are :func:`eventloom.plans.sync.sync` (decode a
block range into one table per event) and :func:`eventloom.plans.logs.get_logs`
(answer a log filter over the decoded tables).
"""
