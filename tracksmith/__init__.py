"""Analytics of agent trajectories on Spark: splits, contracts, transcripts, replay, rewards, credit, evaluation."""
