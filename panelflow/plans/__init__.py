"""panelflow.plans"""
