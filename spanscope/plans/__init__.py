"""Position plans: which positions are perturbed for which distance."""
