"""Multi-step jobs: matching, learning, template filling."""
