"""The three requests a user makes, each as one lazy plan over tables."""
