"""Analytics of agent trajectories and of the datasets around them, on PySpark."""
