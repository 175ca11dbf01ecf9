"""peakforge.plans"""
