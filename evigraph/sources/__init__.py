"""Where graphs come from and where results go."""
